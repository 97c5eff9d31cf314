"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Every pattern reads a text once: local parts of addresses are extended from the ``@`` sign, digit runs are entered at
their first digit only, so no text, however long or uniform, makes the search quadratic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, table, text_slices
from tessela.llm.registry import query

# The kinds in the order of ties; the first four are always reported, the others by score
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

# Words that raise the score of a kind within WINDOW characters, or lower it just before the span
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "kontakt"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llama"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("version", "order", "invoice", "isbn", "sku", "release")
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35}
WINDOW, RAISE, LOWER, THRESHOLD = 48, 0.3, 0.2, 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number without spaces passes the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            yield m.span()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if mod97(code):
            yield m.span()
            continue
        # a following word in capitals may have been taken along: the longest head that passes
        cut = m[0].rfind(" ")
        while cut > 14:
            if mod97(m[0][:cut].replace(" ", "")):
                yield m.start(), m.start() + cut
                break
            cut = m[0].rfind(" ", 0, cut)


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _SSN.finditer(text))


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    raised = RAISE if any(w in near for w in CONTEXT[kind]) else 0.0
    before = {w.lower() for w in _WORDS.findall(text[max(0, start - WINDOW // 3) : start])}
    lowered = LOWER if any(w in before for w in AGAINST) else 0.0
    return round(min(1.0, max(0.0, PRIOR[kind] + raised - lowered)), 3)


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text in code points, by start, then kind."""
    if not text:
        return []
    found = []
    for rank, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            s = score(text, kind, start, end)
            if kind in BASE_KINDS or s >= threshold:
                found.append((start, rank, kind, end, s))
    return [(kind, start, end, s) for start, _, kind, end, s in sorted(found)]


def redacted(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, spans: str = "pii_spans", redact: bool = False) -> DataFrame:
    """Add the column ``spans`` with all personal data of ``text``; with ``redact`` also replace the spans in the text.

    One pass without a shuffle; every row is judged alone. Null and empty texts have an empty list and stay as they are.
    Repeated rows are judged alike. Other columns, whatever their names, pass through; a column named like ``spans`` is
    replaced. An empty table gives an empty table.
    """
    df = df.drop(spans)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, 1 << 20):
                texts = part.column(place).to_pylist()
                found = [spans_of(t, threshold) for t in texts]
                columns = part.columns
                if redact:
                    columns[place] = pa.array([redacted(t, s) for t, s in zip(texts, found, strict=True)], part.schema.field(place).type)
                rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in row] for row in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW)], names=[*part.schema.names, spans])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return arrow_map(df, run, f"{fields}, `{spans}` {_SPANS}")


def digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("pii_spans")
    kinds = F.transform(s, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(digest_text(base), 256).alias("base_sha256"), digest_text(s).alias("spans"))
