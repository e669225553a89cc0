"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. They and looser forms of the same data, such as addresses written
with ``(at)``, national telephone numbers or cards with other separators, are candidates. Labelers vote on each: patterns,
gazetteers, checksums, the words before and the characters around. Expectation-maximisation estimates from all candidates
of the corpus how reliable each labeler is, and its posteriors train a span classifier. What that accepts is added.

How a candidate was voted on and what it looks like is one of at most ``4 * 3 ** 6 * 2 ** 5`` patterns; only the count of
each pattern leaves the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import stored, unused

KINDS = ("email", "ip", "card", "phone")
#: The least probability of a span that is added.
ACCEPT = 0.9
LABELERS = 6
SHAPE_BITS = 5
ROUNDS = 60
CONTEXT = 40

# Endings of host names, first digits of card issuers, words that announce a kind or something else.
ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn ru br in ch at se".split())
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CUES = {
    "email": re.compile(r"(?i)e-?mail|contact|write to|reach|correo|courriel|@"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login|client|adresse"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment"),
    "phone": re.compile(r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|cell|telefon|t[eé]l"),
}
OTHERS = re.compile(r"(?i)version|isbn|issn|order|invoice|serial|ticket|page|chapter|section|figure|\bno\.|\bid\b|ref\b")

DIGIT = re.compile("[0-9]")
# The base patterns, written so that a failed attempt is not repeated from each later character of the same run.
IP = re.compile(r"[0-9]++(?P<whole>\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")

# Looser forms. All have a bounded length.
AT_SIGN = re.compile(r"(?i)\x20?[\[({<]\x20?at\x20?[\])}>]\x20?")
LOOSE_HOST = re.compile(r"(?i)[a-z0-9-]{1,63}(?:(?:\.|\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?)[a-z0-9-]{1,63}){1,5}")
LOOSE = {
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])){3}[0-9]{1,3}(?![0-9A-Za-z.:])"
                     r"|(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z.:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/]|\x20?-\x20?)[0-9]{4}(?:[._/]|\x20?-\x20?)[0-9]{4}(?:[._/]|\x20?-\x20?)[0-9]{1,7}(?![0-9A-Za-z])"
                       r"|(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\+[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
                        r"|(?<![0-9A-Za-z+.-])00[1-9][0-9]{0,2}[\x20.-][0-9](?:[\x20.-]?[0-9]){6,11}(?![0-9A-Za-z])"),
}

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    short = part.lstrip("0")
    return len(short) < 4 and int(short or 0) < 256


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SET:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the strict patterns: leftmost, not overlapping within a kind."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    found["email"] = list(emails(text))
    if not DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in IP.finditer(text) if m["whole"] and all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found["phone"].append(m.span())
    return found


def loose_spans(text: str, base: dict[str, list[Span]]) -> Iterator[tuple[str, Span]]:
    """Looser candidates that overlap no base span and no earlier candidate."""
    taken = sorted(s for spans in base.values() for s in spans)
    found: list[tuple[str, Span]] = []
    for at in AT_SIGN.finditer(text):
        local = LOCAL.search(text, max(0, at.start() - 64), at.start())
        host = LOOSE_HOST.match(text, at.end(), at.end() + 400)
        if local and local[0] and host:
            found.append(("email", (local.start(), host.end())))
    if DIGIT.search(text):
        for kind, pattern in LOOSE.items():
            found += [(kind, m.span()) for m in pattern.finditer(text)]
    starts = np.array([s for s, _ in taken], np.int64)
    last = 0
    for kind, (start, end) in sorted(found, key=lambda x: x[1]):
        i = int(np.searchsorted(starts, end)) if len(starts) else 0
        near = taken[max(0, i - len(KINDS) * 2) : i]
        if start >= last and all(e <= start for _, e in near):
            yield kind, (start, end)
            last = end


def pattern_of(text: str, kind: str, start: int, end: int, strict: bool) -> int:
    """The votes of the labelers, -1, 0 or 1 each, and the shape of a candidate, as one number."""
    span = text[start:end]
    before = text[max(0, start - CONTEXT) : start]
    digits = "".join(filter(str.isdigit, span)) if kind != "email" else ""
    if kind == "email":
        ending = re.split(r"(?i)\.|dot\x20?.?\x20?", span)[-1].lower()
        valid, listed = (1 if 2 <= len(ending) <= 24 and ending.isalpha() else -1), (1 if ending in ENDINGS else 0)
    elif kind == "ip":
        parts = re.findall("[0-9]+", span)
        valid = 1 if ":" in span or all(map(small, parts)) else -1
        listed = -1 if ":" not in span and (parts[0] in ("0", "255") or parts[1:] == ["0", "0", "0"]) else 1
    elif kind == "card":
        valid, listed = (1 if 13 <= len(digits) <= 19 and luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else 0)
    else:
        valid, listed = (1 if 9 <= len(digits) <= 15 else -1), (-1 if len(digits) == 10 and digits[0] in "01" else 1)
    cue, other = bool(CUES[kind].search(before)), bool(OTHERS.search(before))
    around = text[start - 1 : start] + text[end : end + 1]
    votes = (
        1 if strict else 0,
        valid,
        listed,
        cue - other if cue != other else 0,
        -1 if any(c.isalnum() for c in around) else 1,
        -1 if digits and (len(set(digits)) < 3 or digits in "01234567890123456789") else 0,
    )
    shape = (strict, cue, start == 0 or text[start - 1] == "\n", end - start > 16, around[:1] in "([<\"'")
    number = 0
    for vote in votes:
        number = number * 3 + vote + 1
    for bit in shape:
        number = number * 2 + int(bit)
    return number + KINDS.index(kind) * 3**LABELERS * 2**SHAPE_BITS


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: ``id``, ``base`` and ``loose``, arrays of kind, start, end and pattern; stored."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    entry = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_out, loose_out = [], []
            for first in range(0, batch.num_rows, 256):
                for text in batch.column("text").slice(first, 256).to_pylist():
                    base = base_spans(text)
                    base_out.append([(KINDS.index(k), a, b, pattern_of(text, k, a, b, True)) for k in KINDS for a, b in base[k]])
                    loose_out.append(
                        [(KINDS.index(k), a, b, pattern_of(text, k, a, b, False)) for k, (a, b) in loose_spans(text, base)]
                    )
            lists = [pa.array(x, pa.list_(entry)) for x in (base_out, loose_out)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", "base", "loose"])

    spans = "array<struct<kind: int, start: long, end: long, pattern: int>>"
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(find, f"id {kind}, base {spans}, loose {spans}"), "pii")


def decoded(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and shape bits of patterns."""
    rest, bits = np.divmod(patterns, 2**SHAPE_BITS)
    kinds, rest = np.divmod(rest, 3**LABELERS)
    votes = np.stack([rest // 3**i % 3 for i in reversed(range(LABELERS))], axis=1)
    shape = np.stack([bits >> i & 1 for i in reversed(range(SHAPE_BITS))], axis=1)
    return kinds, votes, shape


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over candidates of one kind.

    Returns the posterior of each pattern and ``chance[y, labeler, vote]``. It starts from the votes' majority, which also
    says which class is which; every vote has one imagined case of each class.
    """
    posterior = np.clip(0.5 + (votes - 1).sum(axis=1) / (2 * LABELERS), 0.02, 0.98)
    chance = np.empty((2, LABELERS, 3))
    for _ in range(ROUNDS):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        for vote in range(3):
            chance[:, :, vote] = weight @ (votes == vote) + 1
        chance /= chance.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        odds = np.log(prior[1] / prior[0]) + sum(
            np.log(chance[1, i, votes[:, i]] / chance[0, i, votes[:, i]]) for i in range(LABELERS)
        )
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, chance


def accepted_patterns(patterns: np.ndarray, counts: np.ndarray, accept: float = ACCEPT) -> np.ndarray:
    """Patterns that the span classifier accepts, of those with a valid checksum or form.

    A logistic regression on votes and shape, by kind, trained on the posteriors of every pattern, each as often as it
    occurs.
    """
    if not len(patterns):
        return patterns
    kinds, votes, shape = decoded(patterns)
    posterior = np.zeros(len(patterns))
    for kind in np.unique(kinds):
        posterior[kinds == kind] = reliabilities(votes[kinds == kind], counts[kinds == kind].astype(float))[0]
    own = [(kinds == k)[:, None] * np.concatenate([np.eye(3)[votes].reshape(len(votes), -1), shape], axis=1) for k in range(len(KINDS))]
    inputs = np.concatenate([np.eye(len(KINDS))[kinds], *own], axis=1)
    weight = np.sqrt(counts) / np.sqrt(counts).sum()
    layer = np.zeros(inputs.shape[1])
    for _ in range(800):
        guess = 1 / (1 + np.exp(-np.clip(inputs @ layer, -30, 30)))
        layer -= 4 * (inputs.T @ (weight * (guess - posterior)) + 1e-5 * layer)
    valid = votes[:, 1] == 2
    return patterns[valid & (1 / (1 + np.exp(-inputs @ layer)) >= accept)]


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``id``, ``base`` and ``added`` for each row: arrays of ``kind`` (its place in ``KINDS``), ``start`` and ``end``.

    Both are ordered by kind, then start; places count code points, and ends are exclusive. A null or empty text has no
    spans. Repeated rows get the same. An empty table gives no rows.
    """
    rows = candidates(docs, id_column, text_column)
    each = rows.select(F.explode(F.concat("base.pattern", "loose.pattern")).alias("pattern"))
    table = each.groupBy("pattern").count().toPandas().sort_values("pattern")
    good = accepted_patterns(table["pattern"].to_numpy(np.int64), table["count"].to_numpy(np.int64), accept)
    wanted = F.array(*[F.lit(int(p)) for p in good]).cast("array<int>")

    def shaped(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))

    added = F.filter("loose", lambda s: F.array_contains(wanted, s["pattern"]))
    return rows.select("id", shaped(F.col("base")).alias("base"), shaped(added).alias("added"))


def redacted(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The texts with each span replaced by its kind in brackets, for documents with one row for each identifier.

    Where spans overlap, the one that begins first is replaced, and the rest of the other with it.
    """

    @F.udf("string")
    def replace(text: str | None, spans: list) -> str | None:
        if text is None or not spans:
            return text
        out, at = [], 0
        for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind]}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    of, own = unused("_id", docs), unused("_spans", docs)
    spans = found.select(F.col("id").alias(of), F.concat("base", "added").alias(own))
    joined = docs.join(spans, F.col(id_column).eqNullSafe(F.col(of)), "left")
    return joined.withColumn(text_column, replace(F.col(text_column), F.col(own))).select(*docs.columns)
