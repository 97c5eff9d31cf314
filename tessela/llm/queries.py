"""All queries of the subpackage; the modules register theirs when they are imported."""

from tessela.llm import bestfit, langid, merkle, mixing, packing, pii, rabitq, sigtree, spann, substring, tokens, warc, whitening
from tessela.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bestfit", "langid", "merkle", "mixing", "packing", "pii", "rabitq", "sigtree", "spann", "substring", "tokens", "warc", "whitening"]
