"""Personal data: four patterns, and a semi-Markov conditional random field that finds what they miss.

Base spans are the patterns' leftmost, non-overlapping matches that pass their checks. The field then segments each
zone, which is a run of neighbouring words that hold a digit or an at-sign: a segment is up to MAX_WORDS words and has
a type or none; its score sums the weights of features of the whole span (shape, length, digit count, separators, checksum, changes between letters and digits,
the words before). Dynamic programming over a zone's words finds the best boundaries and types together, at a cost
linear in the words. The types are those of the patterns, and secrets: keys and tokens of mixed letters and digits.

Weights are fitted to the likelihood of spans in a bounded sample of zones: base spans, and for secrets those that stand in quotes or behind
a sign of assignment. Half of the zones are disguised (other separators, plus signs, at-signs, quotes or case), so that the whole span's form counts and not the exact notation. Segments
that score at least `least` above none and overlap no base span are added.

Edge cases: null text is empty and has no span; texts without digit or at-sign are done at once; every search is
linear in the text's length; repeated rows, and those of null ids, are searched row by row; an empty table gives an empty result; without
training zones nothing is added; of equal scores, no type and fewer words win; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import chunks, drop_kept, hash_share

#: The first four are the patterns'.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
MAX_WORDS = 6
Span = tuple[int, int, int]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DIGITS = re.compile(r"[0-9]")
_KEY = re.compile(r"(?<=[\"'=:])[A-Za-z0-9_+/=-]{16,}(?=[\"'\s,;]|$)")
_TURN = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, by start, then kind."""
    if not _HINT.search(text):
        return []
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 9 and int(p) <= 255 or not p.strip("0") for p in (x if len(x) < 9 else x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def seed_secrets(text: str) -> list[Span]:
    """Keys in quotes or behind a sign of assignment, of letters and digits that change places often: what secrets are learned from."""
    return [(m.start(), m.end(), SECRET) for m in _KEY.finditer(text) if len(_TURN.findall(m.group())) >= 4]


def zones(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words with a digit or an at-sign, no more than two characters apart."""
    run: list[tuple[int, int]] = []
    for m in _WORD.finditer(text):
        if run and m.start() - run[-1][1] > 2:
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


_TRIM_L, _TRIM_R = "\"'<[{,;:=|!?*&%$#.", "\"'>]},;:=|!?*&%$#.-_("
Feature = tuple
Weights = dict[Feature, float]


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without quotes, brackets and marks at the ends."""
    while a < b and text[a] in _TRIM_L:
        a += 1
    while b > a and text[b - 1] in _TRIM_R:
        b -= 1
    return a, b


def span_features(text: str, a: int, b: int, n_words: int) -> list[Feature]:
    """What the field sees of a whole span."""
    s = text[a:b]
    digits = "".join(_DIGITS.findall(s))
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s))
    marks = "".join(sorted(set(shape) - set("9a")))
    parts = re.split(r"[^0-9A-Za-z]+", s)
    before = text[max(0, a - 32) : a].split()
    letters, turns = sum(c.isalpha() for c in s), len(_TURN.findall(s))
    return [
        ("n", min(len(digits), 20)), ("words", n_words), ("marks", zlib.crc32(marks.encode("utf-8", "replace")) % 4096), ("shape", zlib.crc32(shape.encode("utf-8", "replace")) % 65536), ("letters", letters * 4 // max(1, len(s))),
        ("luhn", 12 <= len(digits) <= 19 and luhn(digits), len(digits) * 2 > len(s)), ("quad", len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)),
        ("at", s.count("@"), len(parts) > 1 and parts[-1].isalpha()), ("first", s[:1] if s[:1] in "+0(" else ""), ("range", 9 <= len(digits) <= 15, letters > 0),
        ("length", min(len(s) // 4, 16), letters > 0), ("turns", min(turns, 12)), ("dense", turns * 8 >= len(s), len(marks) > 0), ("quoted", text[max(0, a - 1) : a] in ("'", '"', "=")),
        ("before", zlib.crc32(before[-1].lower().encode("utf-8", "replace")) % 512 if before else -1), ("before2", zlib.crc32(before[-2].lower().encode("utf-8", "replace")) % 512 if before[1:] else -1),
    ]


def _segments(text: str, zone: list[tuple[int, int]]) -> list[list[tuple[int, int, int, list[Feature]]]]:
    """For each word: (words, start, end, features) of the segments that end with it."""
    out = []
    for j in range(len(zone)):
        some = []
        for n in range(1, min(MAX_WORDS, j + 1) + 1):
            a, b = trimmed(text, zone[j - n + 1][0], zone[j][1])
            if b > a:
                some.append((n, a, b, span_features(text, a, b, n)))
        out.append(some)
    return out


def _scores(weights: Weights, features: list[Feature]) -> list[float]:
    return [sum(weights.get((k, f), 0.0) for f in features) for k in range(len(KINDS))]


def decode(weights: Weights, text: str, zone: list[tuple[int, int]]) -> list[tuple[Span, float]]:
    """The best segmentation's typed segments with their scores above none. Ties: no type, then fewer words."""
    best, back = [0.0], [None]
    for j, some in enumerate(_segments(text, zone)):
        top, how = best[j], None
        for n, a, b, features in some:
            for k, s in enumerate(_scores(weights, features)):
                if best[j - n + 1] + s > top + 1e-12:
                    top, how = best[j - n + 1] + s, (n, (a, b, k), s)
        best.append(top)
        back.append(how)
    out, j = [], len(zone)
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j][1:])
            j -= back[j][0]
    return out[::-1]


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def train(samples: list[tuple[str, list[Span]]], rounds: int = 6, rate: float = 0.4, ridge: float = 1e-3) -> Weights:
    """Weights that raise the likelihood of the given spans, by gradient steps of forward and backward sums."""
    weights: defaultdict[Feature, float] = defaultdict(float)
    cases = []
    for text, spans in samples:
        want = {(a, b): k for a, b, k in spans}
        for zone in zones(text):
            segments = _segments(text, zone)
            gold = [(k, f) for some in segments for _, a, b, features in some if (k := want.get((a, b))) is not None for f in features]
            cases.append((segments, Counter(gold)))
    for r in range(rounds):
        for segments, gold in cases:
            n = len(segments)
            scored = [[(m, features, _scores(weights, features)) for m, _, _, features in some] for some in segments]
            ahead = [0.0] + [-1e30] * n
            for j, some in enumerate(scored):
                ahead[j + 1] = _log_sum([ahead[j], *(ahead[j - m + 1] + s for m, _, ss in some for s in ss)])
            behind = [-1e30] * n + [0.0]
            for i in range(n - 1, -1, -1):
                behind[i] = _log_sum([behind[i + 1], *(behind[i + m] + s for m in range(1, min(MAX_WORDS, n - i) + 1) for w, _, ss in scored[i + m - 1] if w == m for s in ss)])
            grad: defaultdict[Feature, float] = defaultdict(float, {f: float(c) for f, c in gold.items()})
            for j, some in enumerate(scored):
                for m, features, ss in some:
                    for k, s in enumerate(ss):
                        p = math.exp(min(0.0, ahead[j - m + 1] + s + behind[j + 1] - ahead[n]))
                        if p > 1e-4:
                            for f in features:
                                grad[(k, f)] -= p
            for f, g in grad.items():
                weights[f] += rate / (1 + r) * (g - ridge * weights[f])
    return {f: w for f, w in weights.items() if abs(w) > 1e-3}


def _other_notation(s: str, kind: int, salt: int) -> str:
    """A span as it may be written to evade patterns."""
    if kind == 0:
        return s.replace("@", ("(@)", "[@]", "@")[salt % 3]).replace(".", ("[.]", ",", "(.)")[salt % 3])
    if kind == 1:
        return s.replace(".", ("[.]", ",", "-", "(.)")[salt % 4])
    if kind == 2:
        mark = ". ./ /_"[2 * (salt % 4) : 1 + 2 * (salt % 4)]
        return re.sub(r"[ -]", mark, s) if re.search(r"[ -]", s) else "".join(c + (mark if i % 4 == 3 and i + 1 < len(s) else "") for i, c in enumerate(s))
    if kind == 3:
        return (("", "00", "(+)", "0")[salt % 4]) + s[1:]
    cut = s[: max(16, len(s) - salt % 13)]
    return (cut, cut.upper(), "-".join(cut[i : i + 8] for i in range(0, len(cut), 8)))[salt % 3]


def disguised(text: str, spans: list[Span], salt: int) -> tuple[str, list[Span]]:
    """The same text with the spans written another way, secrets without their quotes."""
    out, new, size, at = [], [], 0, 0
    for a, b, k in spans:
        if a < at:
            continue
        s, left = _other_notation(text[a:b], k, salt), text[at:a]
        if k == SECRET and salt % 2:
            left = left.rstrip("\"'=: ") + " "
        out += [left, s]
        size += len(left) + len(s)
        new.append((size - len(s), size, k))
        at = b + (k == SECRET and salt % 2 == 1 and text[b : b + 1] in ("'", '"'))
    return "".join([*out, text[at:]]), new


def excerpts(text: str, around: int = 40) -> Iterator[str]:
    """Each zone with some text on both sides, cut at white space."""
    for zone in zones(text):
        a, b = zone[0][0], zone[min(len(zone), 12) - 1][1]
        left = text.rfind(" ", max(0, a - around), a)
        right = text.find(" ", b, b + around)
        yield text[left + 1 if left >= 0 else a : right if right >= 0 else b][:600]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 4000, most_zones: int = 500) -> Weights:
    """Weights from at most most_zones zones of about most_rows documents, picked by hashes of ids and zones."""
    share = min(1.0, most_rows / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, texts in chunks(batch, "text") for t in texts if _HINT.search(t) for x in excerpts(t)]
            found = sorted(set(found), key=lambda x: zlib.crc32(x.encode("utf-8", "replace")))[:most_zones]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["zone"])

    got = docs.where(hash_share(id_col) < share).select(F.col(text_col).alias("text")).mapInArrow(run, "zone string")
    picked = got.distinct().orderBy(F.crc32("zone"), "zone").limit(most_zones)
    return train(training_set([r["zone"] for r in picked.collect()]))


def training_set(found: list[str]) -> list[tuple[str, list[Span]]]:
    """Each zone with its spans; and, where it has any, in two other notations."""
    samples = []
    for i, text in enumerate(found):
        base = base_spans(text)
        spans = sorted([*base, *(x for x in seed_secrets(text) if not any(a < x[1] and x[0] < b for a, b, _ in base))])
        spans = [(*trimmed(text, a, b), k) for a, b, k in spans]
        samples.append((text, spans))
        if spans:
            samples += [(t, [(*trimmed(t, a, b), k) for a, b, k in more]) for t, more in (disguised(text, spans, 2 * i), disguised(text, spans, 2 * i + 1))]
    return samples


def find(weights: Weights, text: str, least: float = 3.0) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by start, then kind."""
    base = base_spans(text)
    if not weights or not _HINT.search(text):
        return base, base
    taken = sorted((a, b) for a, b, _ in base)
    more, i, reach = [], 0, 0
    for zone in zones(text):
        for (a, b, k), s in decode(weights, text, zone):
            while i < len(taken) and taken[i][0] < b:
                reach = max(reach, taken[i][1])
                i += 1
            if s >= least and reach <= a:
                more.append((a, b, k))
    return base, sorted(base + more, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans: list[Span]) -> str:
    """Each span, overlapping ones together, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long, n_spans long"


def detect(docs: DataFrame, weights: Weights, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans with the counts of secrets, of added spans and of all, of every row of docs; one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType.fromDDL(OUT)
    none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0, 0)

    def row(text: str | None, weights: Weights) -> tuple:
        if not text or not _HINT.search(text):
            return none
        base, spans = find(weights, text)
        counts = Counter(k for _, _, k in base)
        secrets = sum(k == SECRET for _, _, k in spans)
        return (*(counts[k] for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), secrets, len(spans) - len(base), len(spans))

    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        weights = shipped.value
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                cols = zip(*(row(t, weights) for t in texts), strict=True)
                ids = batch.column("doc_id").slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, weights: Weights, *, text_col: str = "text") -> DataFrame:
    """docs with every span in the text masked; all other columns and null texts as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        weights = shipped.value
        for batch in batches:
            column = batch.schema.get_field_index(text_col)
            for at, texts in chunks(batch, text_col):
                part = batch.slice(at, len(texts))
                new = [t if not t or not _HINT.search(t) else masked(t, find(weights, t)[1]) for t in texts]
                absent = part.column(column).is_null().to_pylist()
                yield part.set_column(column, text_col, pa.array([None if no else t for t, no in zip(new, absent, strict=True)], batch.schema.field(column).type))

    return docs.mapInArrow(run, docs.schema)
