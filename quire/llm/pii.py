"""Personal data in texts: expressions propose spans, validators confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) stay whatever their score; the added kinds (iban, national_id,
local_phone) stay only if checksum and context lift them to the threshold and no earlier span overlaps.
Every expression is walked in time linear in the text: what could be scanned again from each start of a
long run is anchored at what the run must meet, without changing which matches are leftmost.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import columns_apart, pieces

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone")
THRESHOLD = 0.5
#: Scores before context, and what a word nearby adds to or takes from them.
SCORE = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3}
BONUS = 0.3
#: Words that raise a kind's score, in the code points before and after a span.
CONTEXT = {
    "email": "e-?mail|mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|mastercard|credit|debit|payment", "phone": "phone|tel|telephone|mobile|call|fax|telefon|tel[eé]fono",
    "iban": "iban|bank|account|konto|cuenta|compte", "national_id": "ssn|social|security|national", "local_phone": "phone|tel|telephone|mobile|call|fax|telefon|tel[eé]fono",
}
#: Words that lower it: numbers of versions and chapters look like addresses.
AGAINST = {"ip": "version|release|section|chapter|v"}
BEFORE, AFTER = 48, 24

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b", re.A)
NATIONAL_ID = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.A)
LOCAL_PHONE = re.compile(r"\b[0-9]{3,4}[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4}){0,2}\b", re.A)

_CONTEXT = {k: re.compile(rf"\b(?:{v})\b", re.A | re.I) for k, v in CONTEXT.items()}
_AGAINST = {k: re.compile(rf"\b(?:{v})\b", re.A | re.I) for k, v in AGAINST.items()}
_NOT_DIGIT = str.maketrans("", "", " ().-+")


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod_97(code: str) -> bool:
    """Whether an account number's check digits hold: letters count from 10, the first four characters go last."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """Only an @ can end a local part, so each is tried once, with all of the run before it that no earlier match holds."""
    last, seen = 0, 0
    while (at := text.find("@", seen)) >= 0:
        run = text[last:at]
        start = last + len(run.rstrip(LOCAL))
        seen = last = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            seen = last = m.end()
            yield start, m.end()


def ips(text: str):
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := m[0].translate(_NOT_DIGIT)) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 8 <= len(m[0].translate(_NOT_DIGIT)) <= 15:
            yield m.span()


def ibans(text: str):
    """An account number, or one without its last group, which may be the next word."""
    for m in IBAN.finditer(text):
        for code in (m[0], m[0].rpartition(" ")[0]):
            if 15 <= len(code.replace(" ", "")) <= 34 and mod_97(code):
                yield m.start(), m.start() + len(code)
                break


def national_ids(text: str):
    for m in NATIONAL_ID.finditer(text):
        area, group, serial = m[0].split("-")
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if "-" not in around and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def local_phones(text: str):
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(m[0].translate(_NOT_DIGIT)) <= 12:
            yield m.span()


_PROPOSE = dict(zip((*BASE, *ADDED), (emails, ips, cards, phones, ibans, national_ids, local_phones), strict=True))


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    out = SCORE[kind] + BONUS * any(_CONTEXT[kind].search(a) is not None for a in around)
    if kind in _AGAINST:
        out -= BONUS * any(_AGAINST[kind].search(a) is not None for a in around)
    return round(min(out, 1.0), 2)


def _covered(found: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that the spans cover."""
    starts, ends = [], []
    for _, s, e, _ in sorted(found, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start; code points, end exclusive."""
    out: list = []
    for kind, propose in _PROPOSE.items():
        found = [(kind, s, e, score(text, kind, s, e)) for s, e in propose(text)]
        if kind in ADDED and found:
            starts, ends = _covered(out)
            last = [bisect_left(starts, e) - 1 for _, _, e, _ in found]
            found = [x for x, i in zip(found, last, strict=True) if x[3] >= threshold and (i < 0 or ends[i] <= x[1])]
        out += found
    return out


SPAN = "struct<kind:string,start:long,end:long,text:string,score:double>"


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of every whole text: spans(kind, start, end, text, score) by kind as listed, then start.

    A null text is empty and has none; null ids and repeated rows come back as they are. Only doc_id and text are
    read, so other columns may have any name. A text is held by one task with its matches, nothing else is gathered.
    """

    def run(batches):
        for b in batches:
            for piece in pieces([b]):
                rows = []
                for text in piece.column(1).to_pylist():
                    text = text or ""
                    rows.append([{"kind": k, "start": s, "end": e, "text": text[s:e], "score": x} for k, s, e, x in spans(text, threshold)])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


@columns_apart
def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; of overlapping spans the first, then the longest, names the place. A null text stays null."""
    names, at = docs.columns, docs.columns.index("text")

    def hidden(text: str) -> str:
        out, last = [], 0
        for kind, s, e, _ in sorted(spans(text, threshold), key=lambda x: (x[1], -x[2])):
            if s >= last:
                out += [text[last:s], f"[{kind.upper()}]"]
            last = max(last, e)
        return "".join(out) + text[last:]

    def run(batches):
        for b in batches:
            for piece in pieces([b], column=at):
                text = pa.array([None if t is None else hidden(t) for t in piece.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(piece.columns)], names)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Over find(): counts of the base kinds, a digest of the base spans, and all spans, as kind:start:end joined by commas."""
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda c: F.array_join(F.transform(c, told), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = of(*BASE)
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
