"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from almanack.llm.textkit import release

#: The order in which kinds are listed; the first four are the base, which a score never removes.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "local_phone", "social_number")
#: An added span is kept from this score on.
LEAST = 0.5
#: Score of a match that its validator has confirmed, and what a word for or against it within reach adds.
SCORES = {"email": 0.6, "ip": 0.4, "card": 0.7, "phone": 0.6, "iban": 0.8, "short_card": 0.4, "area_phone": 0.5, "local_phone": 0.3, "social_number": 0.3}
FOR, AGAINST = 0.25, 0.25
#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 24
#: Fixed lists: words that make a kind likelier, in some common languages, and words of other numbers.
CONTEXT = {
    "email": "mail email contact correo courriel kontakt",
    "ip": "ip host server client address adresse",
    "card": "card credit debit visa mastercard amex carte karte kreditkarte tarjeta",
    "phone": "phone telephone tel call mobile fax cell telefon handy anruf téléphone portable teléfono móvil",
    "iban": "iban bank account konto compte cuenta transfer",
    "social_number": "ssn social security",
}
CONTEXT |= {"short_card": CONTEXT["card"], "local_phone": CONTEXT["phone"]}
OTHER = "isbn issn order invoice version serial sku part lot page volume article id"
#: Lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_AREA = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_TRIPLES = re.compile(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """From each at sign back over what may stand before it, so no start is tried twice."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """Digit groups with single dots between them, four by four."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                out.append((at, at + size))
            at += size + 1
    return out


def _cards(text: str, least: int, most: int) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= least and least <= len(d := _NOT_DIGIT.sub("", m.group())) <= most and luhn(d):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def _ibans(text: str) -> list[tuple[int, int]]:
    """Exactly as many letters and digits as the country has, single spaces between them allowed."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        need = IBAN_LENGTHS.get(m.group()[:2])
        if not need or m.start() and text[m.start() - 1].isalnum():
            continue
        seen, i = 0, m.start()
        while i < m.end() and seen < need:
            seen += text[i] != " "
            i += 1
        if seen == need and not (i < len(text) and text[i].isalnum()) and mod97(text[m.start() : i].replace(" ", "")):
            out.append((m.start(), i))
            at = i
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Confirmed spans (start, end), in code points, of the four base kinds, each leftmost and non-overlapping."""
    if not _ANY.search(text):
        return {k: [] for k in BASE}
    return {"email": _emails(text), "ip": _addresses(text), "card": _cards(text, 16, 19), "phone": _phones(text)}


_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_OTHER = frozenset(OTHER.split())


def _adjusted(text: str, kind: str, start: int, end: int, score: float) -> float:
    near = set(_WORD.findall(text[max(0, start - BEFORE) : start].lower())) | set(_WORD.findall(text[end : end + AFTER].lower()))
    score += FOR * bool(near & _CONTEXT[kind]) - AGAINST * bool(near & _OTHER)
    return round(min(1.0, max(0.0, score)), 4)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by kind as listed, then start. Added ones reach LEAST and touch no
    base span; of two that touch, the one of the greater score stays, then the earlier, then the kind listed first."""
    base = base_spans(text)
    out = [(k, s, e, _adjusted(text, k, s, e, SCORES[k])) for k in BASE for s, e in base[k]]
    if not _ANY.search(text):
        return out
    apart = lambda m: not (m.start() and text[m.start() - 1].isalnum())
    proposed = [("iban", *x, SCORES["iban"]) for x in _ibans(text)]
    proposed += [("short_card", *x, SCORES["short_card"]) for x in _cards(text, 13, 15)]
    proposed += [("local_phone", *m.span(), SCORES["area_phone"]) for m in _AREA.finditer(text)]
    proposed += [("local_phone", *m.span(), SCORES["local_phone"]) for m in _TRIPLES.finditer(text) if apart(m)]
    proposed += [("social_number", *m.span(), SCORES["social_number"]) for m in _SOCIAL.finditer(text) if apart(m) and m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000"]
    scored = [(-a, s, KINDS.index(k), e) for k, s, e, x in proposed if (a := _adjusted(text, k, s, e, x)) >= LEAST]
    taken = sorted((s, e) for k in BASE for s, e in base[k])
    merged: list[list[int]] = []
    for s, e in taken:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    starts, ends = [x[0] for x in merged], [x[1] for x in merged]
    for a, s, k, e in sorted(scored):
        i = bisect.bisect_right(ends, s)
        if i == len(starts) or starts[i] >= e:
            starts.insert(i, s)
            ends.insert(i, e)
            out.append((KINDS[k], s, e, -a))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii`, an array of (kind, start, end, score) of each whole text: code points, end exclusive.

    Base kinds (email, ip, card, phone) are found leftmost and non-overlapping per kind and dropped if their
    validator fails (parts to 255, Luhn, number of digits). The method adds account numbers that pass mod 97,
    cards of 13 to 15 digits, phones without a country code and social numbers, kept if their score, moved by
    words nearby, reaches LEAST. All other columns stay, of any name but `pii`, which is replaced; null and
    empty texts have no spans; repeated rows each get theirs. Time is linear in the text. One narrow pass.
    """
    import pyspark.sql.types as T

    span = "array<struct<kind: string, start: long, end: long, score: double>>"
    docs = docs.drop("pii")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T._parse_datatype_string(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t.as_py() or "")] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "pii"])
        release()

    return docs.mapInArrow(run, schema)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans by the first one's kind."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def mask(text: str) -> str:
        out, end = [], 0
        for k, s, e, _ in sorted(spans_of(text), key=lambda x: (x[1], -x[2])):
            if s >= end:
                out += [text[end:s], f"[{k}]"]
            end = max(e, end)
        return "".join([*out, text[end:]])

    def run(batches):
        for batch in batches:
            texts = pa.array([None if (v := t.as_py()) is None else mask(v) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, schema)


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    found = find_pii(docs.select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
    )
