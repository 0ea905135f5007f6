"""Personal data and secrets in texts.

Regular expressions propose spans, validators confirm or reject them, and words
nearby move the score.  A built-in pre-filter, which every proposal implies, keeps
texts without anything to propose out of Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Apart, Overlaps

#: Characters before and after a span in which context words count.
REACH = 60
#: Spans of a lower score are not reported.
MIN_SCORE = 0.5
#: Longer spans, which only secrets are, have no shorter ends: what begins a refused key is refused as well.
SHORTENED = 100


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card(value: str) -> bool | None:
    digits = regex.sub(r"\D", "", value)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)


IBAN_LENGTHS = dict(
    x.split(":") for x in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 "
        "GR:27 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 KW:30 KZ:20 LB:28 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MT:31 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VG:24 XK:20"
    ).split()
)


def iban(value: str) -> bool:
    """Length by country and the remainder modulo 97."""
    s = value.replace(" ", "").upper()
    if str(len(s)) != IBAN_LENGTHS.get(s[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ipv4(value: str) -> bool:
    parts = value.split(".")
    return all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts) and parts[0] != "0"


def us_ssn(value: str) -> bool:
    a, b, c = value.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def phone(value: str) -> bool:
    return 8 <= len(regex.sub(r"\D", "", value)) <= 15


def national(value: str) -> bool:
    """Of the ends that a phone number may have, the one by its country's fixed length, where that is known."""
    return value.startswith("+1") and len(regex.sub(r"\D", "", value)) == 11


def secret(value: str) -> bool:
    """A key of at least 20 characters of which no few make up the most."""
    key = regex.search(r"[A-Za-z0-9_\-/+]{20,}", value)
    return key is not None and len(set(key[0])) >= 8


class Kind(NamedTuple):
    name: str
    pattern: str
    valid: Callable[[str], bool] | None
    #: Score without context words, with them, and with words that speak against it.
    score: float
    plus: str
    minus: str
    #: What of the valid ends of a span that is too long counts most, before its length.
    likely: Callable[[str], bool] | None = None


KINDS = (
    Kind("email", r"(?<![\w.+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])", None, 0.9, "mail contact write", "noreply"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban, 0.9, "iban account bank konto compte cuenta", ""),
    Kind("secret", r"(?i)(?<![\w])(?:api[_-]?key|secret|token|passw(?:or)?d)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_\-/+]{20,}", secret, 0.9, "auth bearer key", ""),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])(?:gh[oprsu]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk_live_[A-Za-z0-9]{16,255}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", None, 0.9, "", ""),
    Kind("private_key", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s]*+-----END (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY(?: BLOCK)?-----)?", None, 1.0, "", ""),
    Kind("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])", card, 0.8, "card visa mastercard credit payment karte carte tarjeta", "order invoice isbn tracking"),
    Kind("us_ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", us_ssn, 0.6, "ssn social security", "part order"),
    Kind("ipv4", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", ipv4, 0.7, "ip address host server client", "version release"),
    Kind("phone", r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w-])|(?<![\w.+-])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])", phone, 0.7, "phone call tel mobile fax telefon", "order id", national),
    # without a country's number only next to words that say so
    Kind("phone", r"(?<![\w.+/-])\(?0[1-9][0-9]{0,3}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,6}){0,3}(?![\w-]|[.,][0-9])", phone, 0.4, "phone call tel telephone mobile fax telefon", "order id"),
)
CONTEXT = 0.1
#: True wherever one of KINDS proposes anything.
PREFILTER = r"@|[0-9](?:[ .()/-]{0,3}[0-9]){3}|[A-Z]{2}[0-9]{2}|(?i:key|secret|token|passw)|A[KS]IA|gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza"


class Finder:
    def __init__(self, kinds=KINDS, min_score: float = MIN_SCORE):
        self.min_score = min_score
        words = lambda s: regex.compile(r"(?i)(?<!\p{L})(?:" + "|".join(s.split()) + r")(?!\p{L})") if s else None
        self.kinds = [(k, regex.compile(k.pattern), words(k.plus), words(k.minus)) for k in kinds]
        # what may not follow a span, for fullmatch() ignores it where the text is made to end
        self.after = [regex.compile(k.pattern[k.pattern.rfind("(?!") :] if "(?!" in k.pattern else "") for k in kinds]

    def spans(self, rank: int, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Valid spans of a kind from left to right.

        Where the longest span at a start is refused, its shorter ends are tried, then the
        next start.  Of several valid shorter ends the likely one counts, then one that
        leaves alone the spans of other kinds in taken, then the longest.
        """
        kind, pattern = self.kinds[rank][:2]
        pos, met = 0, Overlaps(taken)
        while m := pattern.search(text, pos):
            a, b = m.span()
            if kind.valid is not None and not kind.valid(m[0]):
                ends = [
                    e for e in range(b - 1, a, -1)
                    if b - a <= SHORTENED and self.after[rank].match(text, e) and pattern.fullmatch(text, a, e) and kind.valid(text[a:e])
                ]
                if not ends:
                    pos = a + 1
                    continue
                b = max(ends, key=lambda e: (bool(kind.likely and kind.likely(text[a:e])), not met(a, e), e))
            yield a, b
            pos = b

    def __call__(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) without overlaps: the higher score stays, then the earlier kind, then the earlier span."""
        hits = []
        for rank, (kind, _, plus, minus) in enumerate(self.kinds):
            for a, b in self.spans(rank, text, [(x, y) for _, _, x, y in hits]):
                score = kind.score
                near = text[max(0, a - REACH) : a] + " " + text[b : b + REACH]
                score += CONTEXT * bool(plus and plus.search(near)) - 3 * CONTEXT * bool(minus and minus.search(near))
                if score >= self.min_score - 1e-9:
                    hits.append((-round(min(score, 1.0), 3), rank, a, b))
        chosen = Apart()
        return sorted((a, b, self.kinds[rank][0].name, -s) for s, rank, a, b in sorted(hits) if chosen.add(a, b))


def _scan(min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(min_score=min_score)
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(batch.column(1)):
                t = text.as_py()
                for a, b, kind, score in find(t):
                    rows.append(r)
                    found.append((kind, a, b, t[a:b], score))
            cols = list(zip(*found)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "kind", "start", "end", "value", "score"],
            )

    return run


def scan(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, kind, start, end, value, score) of every confirmed span in docs(doc_id, text).

    start and end count characters, end excluded.  Null and empty texts have none; repeated rows give repeated results; null
    doc_ids stay null.  A text is searched whole, however long; of spans that tie, the earlier kind and then the earlier span stays.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(PREFILTER))
    return texts.mapInArrow(_scan(min_score), f"doc_id {kind}, kind string, start int, end int, value string, score double")
