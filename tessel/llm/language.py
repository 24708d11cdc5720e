"""Language identification by cross-parsing entropy.

Per language, labelled text becomes a suffix automaton. A text is cut greedily into phrases, each the longest match
in the automaton; a language that needs few phrases knows the text. With c phrases over n symbols and training text
of N symbols, the normalised count is c log2(N) / n bits a symbol, and the language with the least wins.

Symbols: letters, lower-cased, with any run of other characters as one blank. Where the training text has more letters than
there are symbols, the commonest have one each and every other letter a sequence of digits of its own; only letters
that no training text holds share a symbol. The automata are laid out as one dense
table, in which a missing edge already holds the start of the next phrase; all blocks of `BLOCK` symbols of all texts of a batch then
advance together, one symbol a step, each from the start state. A block's parse is then made the whole text's: it is begun anew
in the state in which the block before ended, until both parses are in one state, which takes a few symbols.

Edge cases: a null text or one without a letter is `und` with score 0; with no labelled text, every text is `und`;
ties go to the smaller name; repeated rows, and rows of null ids, are predicted row by row, and null ids aren't learned from; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import chunks, drop_kept, fold, hash_share

BLOCK = 256
SYMBOLS = 64  # 0 blank, 1 a letter not in the alphabet, 63 beyond the end
_END = SYMBOLS - 1
_DIGITS = 16  # the last symbols before the end, if letters outnumber the symbols
_FIRST_DIGIT = _END - _DIGITS


@dataclass
class Model:
    names: list[str]
    alphabet: list[int]  # code points of symbols 2, 3, ...; of more than fit, those behind _FIRST_DIGIT - 2 are written in digits
    table: np.ndarray  # (state, symbol) -> 4 * SYMBOLS * next state + phrases begun
    roots: list[int]
    log_n: np.ndarray


@cache
def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _lookup(alphabet: list[int]) -> np.ndarray:
    """A symbol per code point, or SYMBOLS + 8 * number + digits of a letter that is written as a number of so many digits."""
    if len(alphabet) <= SYMBOLS - 3:
        out = _is_letter().astype(np.uint8)
        out[alphabet] = np.arange(2, 2 + len(alphabet))
        return out
    out, single = _is_letter().astype(np.uint32), _FIRST_DIGIT - 2
    out[alphabet[:single]] = np.arange(2, _FIRST_DIGIT)
    digits = 1
    while _DIGITS**digits < len(alphabet) - single:
        digits += 1
    out[alphabet[single:]] = SYMBOLS + 8 * np.arange(len(alphabet) - single) + digits
    return out


def _symbols(lookup: np.ndarray, text: str) -> np.ndarray:
    """Letters as symbols, each run of others as one blank, none at the ends."""
    s = lookup[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    s = s[(s > 0) | (np.concatenate([[0], s[:-1]]) > 0)] if len(s) else s
    s = s[:-1] if len(s) and s[-1] == 0 else s
    return s if s.dtype == np.uint8 else _written(s)


def _written(s: np.ndarray) -> np.ndarray:
    """With letters that are numbers as their digits."""
    number = np.maximum(s.astype(np.int64) - SYMBOLS, 0)
    n = np.where(s >= SYMBOLS, number & 7, 1)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    digit = _FIRST_DIGIT + (np.repeat(number >> 3, n) // _DIGITS**place) % _DIGITS
    s = np.repeat(s, n)
    return np.where(s >= SYMBOLS, digit, s).astype(np.uint8)


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Edges of each state of the suffix automaton, built symbol by symbol; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def _dense(edges: list[dict[int, int]], first: int) -> np.ndarray:
    """A row per state, with states numbered from `first`; an absent edge restarts at the start state."""
    n = len(edges)
    to = np.full((n, SYMBOLS), -1, np.int64)
    for i, e in enumerate(edges):
        for c, j in e.items():
            to[i, c] = j
    unseen = to[0] < 0  # such a symbol is a phrase of its own, and another begins behind it
    begun = np.where(to >= 0, 0, np.where(unseen[None], 2, 1))
    begun[0] = unseen
    table = 4 * SYMBOLS * (first + np.where(to >= 0, to, np.where(unseen, 0, to[0])[None])) + begun
    table[:, _END] = 4 * SYMBOLS * (first + np.arange(n))
    return table


def build(texts: dict[str, str], most_chars: int = 16384) -> Model:
    """A model from each language's text; of longer ones the first most_chars symbols make the automaton."""
    names = sorted(texts)
    seen, times = np.unique(np.frombuffer("".join(texts[k].lower() for k in names).encode("utf-32-le", "replace"), np.uint32), return_counts=True)
    letters = [(-n, int(c)) for c, n in zip(seen, times, strict=True) if _is_letter()[c]]
    common = [c for _, c in sorted(letters)]
    single = SYMBOLS - 3 if len(common) <= SYMBOLS - 3 else _FIRST_DIGIT - 2
    alphabet = sorted(common[:single]) + sorted(common[single:])
    lookup, tables, roots, log_n, first = _lookup(alphabet), [], [], [], 0
    for k in names:
        text = _symbols(lookup, texts[k])[:most_chars]
        edges = automaton(text)
        tables.append(_dense(edges, first))
        roots.append(4 * SYMBOLS * first)
        log_n.append(np.log2(len(text) + 2))
        first += len(edges)
    return Model(names, alphabet, np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32), roots, np.array(log_n))


def phrases(model: Model, parts: list[np.ndarray]) -> np.ndarray:
    """Phrases of each sequence of symbols (a row) under each language (a column)."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    n_blocks = -(-size // BLOCK)
    of = np.repeat(np.arange(len(parts)), n_blocks)
    flat = np.full(int(n_blocks.sum()) * BLOCK, _END, np.uint8)
    at = (np.cumsum(n_blocks) - n_blocks) * BLOCK
    for a, p in zip(at, parts, strict=True):
        flat[a : a + len(p)] = p
    left = np.clip(np.repeat(size, n_blocks) - (np.arange(len(of)) * BLOCK - np.repeat(at, n_blocks)), 0, BLOCK)
    order = np.argsort(-left, kind="stable")  # the fuller blocks first: at each step a prefix is still alive
    steps = np.ascontiguousarray(flat.reshape(-1, BLOCK)[order].T)
    alive = len(of) - np.searchsorted(np.sort(left), np.arange(BLOCK), side="right")
    roots = np.array(model.roots, np.int32)
    state = np.repeat(roots[:, None], len(of), 1)  # a row per language
    count = np.ones(state.shape, np.int32)  # each block begins a phrase
    for i in range(BLOCK):
        if not (n := alive[i]):
            break
        got = model.table[(state[:, :n] >> 2) + steps[i, :n]]
        count[:, :n] += got & 3
        state[:, :n] = got & ~3
    ends, begun = np.empty_like(state), np.empty(state.shape, np.int64)
    ends[:, order], begun[:, order] = state, count
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))
    _continue(model.table, roots, steps, place, left, of, ends, begun)
    return np.stack([np.bincount(of, c, len(parts)) for c in begun], 1) if len(roots) else np.zeros((len(parts), 0))


def _continue(table: np.ndarray, roots: np.ndarray, steps: np.ndarray, place: np.ndarray, left: np.ndarray, of: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> None:
    """Changes phrases and end states of blocks (columns) under each language (rows), parsed from the start state, to those of the parse of whole texts.

    steps holds the symbols by step and place of a block. A block whose two parses don't meet has another end state, so the block after it is parsed once more.
    """
    own = begun.copy()
    block = np.flatnonzero(np.concatenate([[False], of[1:] == of[:-1]])) if len(of) else np.zeros(0, np.int64)
    lang, block = np.repeat(np.arange(len(roots)), len(block)), np.tile(block, len(roots))
    while len(block):
        alone, true, more = roots[lang], ends[lang, block - 1], np.full(len(block), -1, np.int64)  # no phrase begins with the block
        column, size, apart = place[block], left[block], []
        for i in range(BLOCK):
            if i % 4 == 0:  # both parses go on alike once they have met; beyond a text's end neither moves
                done = (alone == true) | (size <= i)
                if done.any():
                    begun[lang[done], block[done]] = own[lang[done], block[done]] + more[done]
                    apart.append((lang[done & (alone != true)], block[done & (alone != true)], true[done & (alone != true)]))
                    lang, block, alone, true, more, column, size = (x[~done] for x in (lang, block, alone, true, more, column, size))
                if not len(block):
                    break
            symbol = steps[i, column]
            a, b = table[(alone >> 2) + symbol], table[(true >> 2) + symbol]
            more += (b & 3) - (a & 3)
            alone, true = a & ~3, b & ~3
        begun[lang, block] = own[lang, block] + more
        apart.append((lang[alone != true], block[alone != true], true[alone != true]))
        lang, block, true = (np.concatenate([x[k] for x in apart]) for k in range(3))
        changed = ends[lang, block] != true
        ends[lang, block] = true
        lang, block = lang[changed], block[changed] + 1
        same = block < len(of)
        lang, block = lang[same], block[same]
        same = of[block] == of[block - 1]
        lang, block = lang[same], block[same]


def predict_texts(model: Model, texts: list[str], lookup: np.ndarray) -> tuple[list[str], np.ndarray]:
    parts = [_symbols(lookup, t) for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    if not model.names:
        return ["und"] * len(texts), np.zeros(len(texts))
    bits = phrases(model, parts) * model.log_n / np.maximum(size, 1)[:, None]
    best = bits.argmin(1)
    odds = np.exp2(-(bits - bits.min(1, keepdims=True)) * np.minimum(size, 32)[:, None])
    p = 1 / odds.sum(1)
    return [model.names[b] if n else "und" for b, n in zip(best, size, strict=True)], np.where(size > 0, p, 0.0)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 64, most_chars: int = 16384, held_out: tuple[int, int] = (4, 2)) -> Model:
    """Automata from about rows_per_language documents of each language, of crc32(id) mod held_out[0] other than held_out[1].

    The share of each language's documents is set from its count, so that no task picks them one by one. About
    most_chars / rows_per_language characters of each, 256 at least, make the automaton; they begin at a place fixed by the
    id's hash, so what all texts of a source begin with doesn't fill it. Shorter texts are taken whole.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("_id", held_out[0]) != held_out[1]))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return build({})
    each = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, max(most_chars // min(n, rows_per_language), 256))))
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, rows_per_language / n))))
    begin = F.pmod(F.xxhash64(F.lit("excerpt"), "_id"), F.greatest(F.length("text") - each[F.col("lang")], F.lit(0)) + 1).cast("int")
    turned = F.concat(F.substring("text", begin + 1, F.lit(most_chars)), F.lit(" "), F.substring("text", F.lit(1), F.least(begin, F.lit(most_chars))))
    excerpt = F.substring(F.when(begin > 0, turned).otherwise(F.col("text")), 1, most_chars).alias("text")  # of training text only
    sample = known.where(hash_share("_id") < share[F.col("lang")]).select("_id", "lang", excerpt)
    # one id may be that of very many documents; two times the expected rows are hardly ever reached otherwise
    sample = sample.orderBy(F.xxhash64("_id", "text"), "_id", "text").limit(2 * rows_per_language * len(counts) + 64)
    got = sample.toArrow().to_pandas().sort_values(["_id", "text"])
    texts: dict[str, str] = {}
    for lang, rows in got.groupby("lang"):
        parts = rows["text"].tolist()
        each = max(most_chars // max(1, len(parts)), 256)
        texts[lang] = " ".join([*(p[:each] for p in parts), *(p[each:] for p in parts)])[: 2 * most_chars]
    return build(texts, most_chars)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row of docs; one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        model = shipped.value
        lookup = _lookup(model.alphabet)
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                names, p = predict_texts(model, texts, lookup)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(names, pa.string()), pa.array(p)], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
