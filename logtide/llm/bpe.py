"""BPE encoding and decoding with a public tokenizer file, by tree concatenation.

A text longer than ``LEAF`` characters is unsplit text: it is halved again and again at any place, its halves are
encoded side by side, and neighbours are joined by re-encoding a growing window of runs around each join until the
window's outer runs have the ids that both sides gave them. Texts over ``SPREAD`` characters are dealt to Spark rows by
piece, so that no task encodes one alone; shorter ones go up their tree in one task. A run without white space that is
itself longer than ``LEAF`` has a tree of its own, of tokens and their places.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from logtide.llm.workers import leaves, tidy

#: Characters that are encoded in one piece; longer texts and runs are halved.
LEAF = 4096
#: Characters of a text that are one row's work; longer texts become rows of so many characters.
SPREAD = 1 << 16
#: Runs, and parts of runs, whose ids a worker remembers, and the longest that is remembered: together they bound its memory.
REMEMBERED, LONGEST = 200_000, 48
#: Characters of texts that are worked on together, about.
TOGETHER = 1 << 22
#: Runs that a piece dealt to another row keeps apart at each end, for the windows; two are enough for agreement.
EDGE = 4
_known: dict[str, Runs] = {}
#: Runs between the white space that the tokenizer's own pattern knows.
_RUN = re.compile("[^\t\n\x0b\x0c\r \x85\xa0  -     　]+")
#: A short run of signs that lower-casing and composition treat one by one.
_WEST = re.compile(rf"[!-~\xa1-\u012f]{{1,{LONGEST}}}").fullmatch
_STOPS = frozenset(".,;:!?)%")
#: Western letters that Arrow lower-cases as Python does, each to one letter; runs of these, with a sign behind or not, are worked on as columns.
_LETTERS = "".join(c for c in map(chr, range(0x21, 0x130)) if c.isalpha() and _WEST(c) and len(c.lower()) == 1 and pc.utf8_lower(pa.scalar(c)).as_py() == c.lower())
_WORD = f"^[{_LETTERS}]+[{''.join(sorted(_STOPS))}]?$"
#: Words of letters whose ids a worker remembers as columns, about 25 bytes each.
SEEN = 600_000
#: Words in one text for the library, and such texts in one call.
_WORDS, _CALL = 500, 64
_SPACE = re.compile(_RUN.pattern.replace("[^", "["))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each Spark task is a thread of work already
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _tokens(path: str) -> dict[int, str]:
    return {i: s for s, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}


def _forget() -> None:
    _known.clear(), tokenizer.cache_clear(), _tokens.cache_clear()


leaves("bpe", lambda: bool(_known), _forget)


def decode(path: str, ids: np.ndarray) -> str:
    """Text of some ids, special ones included; ids that the vocabulary lacks are left out."""
    t = tokenizer(path)
    if t.decoder is not None:
        return t.decode(ids.tolist(), skip_special_tokens=False)
    known = _tokens(path)  # without a decoder of its own, a tokenizer's text is its tokens with spaces between
    try:
        return " ".join(map(known.__getitem__, ids.tolist()))
    except KeyError:
        return " ".join(known[i] for i in ids.tolist() if i in known)


def runs_of(text: str) -> list[str]:
    """Runs between white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the tokenizer
        return _RUN.findall(text)
    return text.split()


class Node(NamedTuple):
    """A piece of text: its runs with their ids, and whether it begins and ends inside a run."""

    items: list[tuple[str | None, bytes]]  # one without text stands for all runs between the edges
    opens: bool
    closes: bool


def join(left: Node, right: Node, ids_of: Callable[[str], bytes]) -> Node:
    """One node from two neighbours; the window around the join grows until its outer runs agree with both sides."""
    gap, w = "" if left.closes and right.opens else " ", 1
    while True:
        a, b = left.items[-w:], right.items[:w]
        whole_left, whole_right = len(a) == len(left.items), len(b) == len(right.items)
        window = " ".join(r for r, _ in a) + gap + " ".join(r for r, _ in b)
        got = [(r, ids_of(r)) for r in runs_of(window)]
        if (whole_left or got[0] == a[0]) and (whole_right or got[-1] == b[-1]):
            items = left.items[: len(left.items) - len(a)] + got + right.items[len(b) :]
            return Node(items, left.opens if left.items else right.opens and not gap, right.closes if right.items else left.closes and not gap)
        w *= 2


def up(level: list[Node], ids_of: Callable[[str], bytes]) -> Node:
    """The node of the whole text from its pieces, in pairs and in order."""
    while len(level) > 1:
        level = [join(*level[k : k + 2], ids_of) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _spans(t: Tokenizer, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
    return [(e.ids, e.offsets) for e in t.encode_batch(texts, add_special_tokens=False)]


def tree_encode(path: str, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of one long run, by halving, encoding the pieces side by side, and joining pairs up the tree.

    A window begins and ends on token bounds. A join holds when the window's first and last tokens, with their
    places, are those of the left and right sides; else the window doubles, up to both sides whole.
    """
    t = tokenizer(path)
    pieces = [text[k : k + leaf] for k in range(0, len(text), leaf)] or [""]
    nodes = [(k * leaf, ids, offs) for k, (ids, offs) in enumerate(_spans(t, pieces))]
    ends = [min(len(text), (k + 1) * leaf) for k in range(len(nodes))]
    level = [(s, e, [(i, s + a, s + b) for i, (a, b) in zip(ids, offs)]) for (s, ids, offs), e in zip(nodes, ends)]
    while len(level) > 1:
        level = [_join(t, text, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return [i for i, _, _ in level[0][2]]


def _join(t: Tokenizer, text: str, left: tuple, right: tuple) -> tuple:
    """One node from two neighbours, each (start, end, [(id, from, to)])."""
    a, b, size = left[2], right[2], 16
    while True:
        i, j = max(0, len(a) - size), min(len(b), size)
        begin, end = (a[i][1] if i else left[0]), (b[j - 1][2] if j < len(b) else right[1])
        whole = not i and j >= len(b)
        (ids, offs), = _spans(t, [text[begin:end]])
        window = [(x, begin + p, begin + q) for x, (p, q) in zip(ids, offs)]
        agree = max(1, size // 4)
        if whole or (
            (not i or window[:agree] == a[i : i + agree]) and (j >= len(b) or window[-agree:] == b[j - agree : j])
        ):
            return left[0], right[1], a[:i] + window + b[j:]
        size *= 2


class Runs(dict):
    """Runs to their ids, little-endian unsigned 32-bit; the tokenizer drops white space and never merges across it."""

    def __init__(self, path: str, leaf: int):
        self.path, self.leaf = path, leaf
        self.tokenizer = tokenizer(path)
        self.parts: dict[str, bytes] = {}
        self.cut = self.bare = None
        self.stops = sorted(_STOPS)
        self.seen, self.seen_ids, self.seen_size = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        end = spec["model"].get("end_of_word_suffix")
        if kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and end:
            self.cut = regex.compile(steps[0]["pattern"]["Regex"])
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(_tokens(path)) + 1, bool)
            self.last[[i for i, x in _tokens(path).items() if x.endswith(end)]] = True

    def __missing__(self, run: str) -> bytes:
        if len(run) > self.leaf:
            return np.array(tree_encode(self.path, run, self.leaf), "<u4").tobytes()
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, texts: list[str]) -> dict[str, bytes]:
        return {r: np.array(e.ids, "<u4").tobytes() for r, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))}

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of letters, many in one call: each ends with the only token that closes a word."""
        out = {}
        parts = [words[k : k + 500] for k in range(0, len(words), 500)]
        for part, made in zip(parts, self.bare.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(made.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                out |= self._plain(part)
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(part, (4 * ends).tolist()):
                out[word] = data[begin:end]
                begin = end
        return out

    def learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of new runs. One of Western letters and signs is lower-cased and cut by the tokenizer's own pattern first."""
        easy, hard = [], []
        for r in runs:
            (easy if self.cut and _WEST(r) and "<|" not in r else hard).append(r)
        out = self._plain([r for r in hard if len(r) <= self.leaf]) | {r: self[r] for r in hard if len(r) > self.leaf}
        letters = list(filter(str.isalpha, easy))
        ended = [r for r in easy if r[-1] in _STOPS and r[:-1].isalpha()]
        other = set(easy).difference(letters, ended)
        low, low_ended = list(map(str.lower, letters)), [r[:-1].lower() for r in ended]
        cut = {r: self.cut.findall(r.lower()) for r in other}
        need = set(low).union(low_ended, _STOPS if ended else (), *cut.values())
        fresh = need.difference(self.parts)
        if len(self.parts) + len(fresh) > REMEMBERED:
            self.parts, fresh = {}, need
        self.parts |= self._letters([x for x in fresh if x.isalpha()]) | self._plain([x for x in fresh if not x.isalpha()])
        found = self.parts.__getitem__
        out.update(zip(letters, map(found, low)))
        out.update((r, found(x) + found(r[-1])) for r, x in zip(ended, low_ended))
        out.update((r, b"".join(map(found, x))) for r, x in cut.items())
        return out

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different lower-case words of letters, one after the other, and how many each has."""
        bounds = np.append(np.arange(0, len(words), _WORDS), len(words)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words), " ").to_pylist()
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(texts), _CALL):
            for i, made in enumerate(self.bare.encode_batch_fast(texts[k : k + _CALL], add_special_tokens=False), k):
                got = np.array(made.ids, "<u4")
                ends = np.flatnonzero(self.last[got]) + 1
                if len(ends) != bounds[i + 1] - bounds[i] or ends[-1] != len(got):
                    each = list(self._plain(words[bounds[i] : bounds[i + 1]].to_pylist()).values())
                    got, ends = np.frombuffer(b"".join(each), "<u4"), np.cumsum(list(map(len, each))) // 4
                ids.append(got), sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Places of different words among the remembered ones, which the new ones join; too many are forgotten first."""
        at = pc.index_in(words, self.seen).fill_null(-1).to_numpy().copy()
        if len(self.seen) + np.count_nonzero(at < 0) > SEEN:
            self.seen, self.seen_ids, self.seen_size = self.seen[:0], self.seen_ids[:0], self.seen_size[:0]
            at[:] = -1
        fresh = at < 0
        if fresh.any():
            new = words.filter(pa.array(fresh))
            ids, size = self._words(new)
            at[fresh] = len(self.seen) + np.arange(len(new))
            self.seen = pa.concat_arrays([self.seen, new])
            self.seen_ids, self.seen_size = np.concatenate([self.seen_ids, ids]), np.concatenate([self.seen_size, size])
        return at

    def table(self, runs: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different runs, one after the other, and how many each has; an empty run has none."""
        easy = np.zeros(len(runs), bool)
        if self.cut:
            easy = pc.and_(pc.match_substring_regex(runs, _WORD), pc.less_equal(pc.utf8_length(runs), LONGEST)).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(runs.filter(pa.array(easy)))
        stop = pc.index_in(pc.utf8_slice_codeunits(low, -1), pa.array(self.stops)).fill_null(-1).to_numpy()
        words = pc.utf8_rtrim(low, "".join(self.stops)).dictionary_encode()
        at = self._places(words.dictionary)
        none = len(self.seen)
        rest = [b"", *map(self.__getitem__, self.stops), *self.of(runs.filter(pa.array(~easy)).to_pylist())]
        ids = np.concatenate([self.seen_ids, np.frombuffer(b"".join(rest), "<u4")])
        size = np.concatenate([self.seen_size, np.fromiter(map(len, rest), np.int64, len(rest)) // 4])
        parts = np.full((len(runs), 2), none)  # a word and the sign behind it
        parts[easy, 0], parts[easy, 1] = at[words.indices.to_numpy()], none + 1 + stop
        parts[~easy, 0] = np.arange(none + 1 + len(self.stops), len(size))
        return _laid(ids, size, parts.reshape(-1)), size[parts].sum(axis=1)

    def of(self, runs: list[str]) -> list[bytes]:
        """Ids of different runs; the short ones are remembered."""
        got = list(map(self.get, runs))
        fresh = self.learn([r for r, x in zip(runs, got) if x is None])
        if fresh:
            got = [fresh[r] if x is None else x for r, x in zip(runs, got)]
            if len(self) + len(fresh) > REMEMBERED:
                self.clear()
            if len(fresh) <= REMEMBERED:
                self.update((r, x) for r, x in fresh.items() if len(r) <= LONGEST)
        return got


def _laid(ids: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of ``codes``, one after the other; ``ids`` holds those of code 0, of code 1 and so on."""
    each = size[codes]
    ends = np.cumsum(each)
    place = np.repeat((np.cumsum(size) - size)[codes] - (ends - each), each)
    place += np.arange(len(place))
    return ids[place]


def _cut(pieces: list[str]) -> pa.ListArray:
    """The runs of each piece; an empty one stands for white space at either end."""
    if any(c in x for x in pieces for c in "\x1c\x1d\x1e\x1f"):  # white space to Arrow, not to the tokenizer
        return pa.array([_SPACE.split(x) for x in pieces], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(pa.array(pieces, pa.string()))


def _known_runs(path: str, leaf: int) -> Runs:
    known = _known.get(path)
    if known is None or known.leaf != leaf:
        known = _known[path] = Runs(path, leaf)
    return known


def _nodes(path: str, texts: list[str], leaf: int, all_nodes: bool = False) -> Iterator[Node | bytes]:
    """Ids of each text of one piece, the node at the top of the tree of each longer one (of each, if ``all_nodes``)."""
    known = _known_runs(path, leaf)
    parts = [[x[k : k + leaf] for k in range(0, len(x), leaf)] or [""] for x in texts]
    cut = _cut([p for x in parts for p in x])
    coded = cut.values.dictionary_encode()
    words, codes, bounds = coded.dictionary, coded.indices.to_numpy(), cut.offsets.to_numpy()
    ids, size = known.table(words)
    full, begin = pc.binary_length(words).to_numpy() > 0, np.cumsum(size) - size
    flat = _laid(ids, size, codes)
    ends = np.cumsum(size[codes])
    ends = np.r_[0, ends]
    at = 0
    for x in parts:
        if len(x) == 1 and not all_nodes:
            yield flat[ends[bounds[at]] : ends[bounds[at + 1]]].tobytes()
        else:
            level, met = [], {}

            def named(a: int, b: int) -> list[tuple[str, bytes]]:
                out = [(words[c].as_py(), ids[begin[c] : begin[c] + size[c]].tobytes()) for c in codes[a:b].tolist() if full[c]]
                met.update(out)
                return out

            def ids_of(run: str) -> bytes:
                got = met.get(run)
                if got is None:
                    got = met[run] = known[run]
                return got

            for p in range(at, at + len(x)):
                i, j = bounds[p], bounds[p + 1]
                if j - i > 2 * EDGE + 2:
                    a, b = i + EDGE + 1, j - EDGE - 1
                    items = named(i, a) + [(None, flat[ends[a] : ends[b]].tobytes())] + named(b, j)
                else:
                    items = named(i, j)
                level.append(Node(items, full[codes[i]], full[codes[j - 1]]))
            yield up(level, ids_of)
        at += len(x)


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= TOGETHER or k + 1 == len(texts):
            yield begin, k + 1
            begin, size = k + 1, 0


def encode(path: str, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
    """Ids of whole texts as the tokenizers library gives them, as unsigned 32-bit arrays."""
    out = []
    for i, j in batches_of(texts):
        for x in _nodes(path, texts[i:j], leaf):
            out.append(np.frombuffer(x if isinstance(x, bytes) else b"".join(i for _, i in x.items), "<u4"))
    return out


_PIECE = "opens boolean, closes boolean, items array<struct<run: string, ids: binary>>"


def _pieces(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    """``rows(id, th, k, n, piece)`` to the node of each piece, its middle runs put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("run", pa.string()), ("ids", pa.binary())]))
        for batch in batches:
            for at in range(0, len(batch), 16):
                part = batch.slice(at, 16)
                out = []
                for top in _nodes(path, part.column(4).to_pylist(), leaf, True):
                    items = top.items
                    if len(items) > 2 * EDGE + 1:
                        items = items[:EDGE] + [(None, b"".join(i for _, i in items[EDGE:-EDGE]))] + items[-EDGE:]
                    out.append((top.opens, top.closes, [{"run": r, "ids": i} for r, i in items]))
                opens, closes, items = zip(*out)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(opens), pa.array(closes), pa.array(items, kind)], [*part.schema.names[:4], "opens", "closes", "items"])

    return rows.select("id", "th", "k", "n", "piece").mapInArrow(tidy(run, "bpe"), f"id {dict(rows.dtypes)['id']}, th long, k int, n long, {_PIECE}")


def token_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """``(id_col, ids binary, decoded)``: ids are little-endian unsigned 32-bit integers; null texts count as empty.

    One row for each input row, repeated ones too, which are encoded once if longer than ``spread``; null ids are ids
    like any other; an empty table gives an empty table; other columns are not read and may have any name.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(chosen.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in batches_of(texts):
                part = batch.slice(i, j - i)
                ids = encode(path, texts[i:j], leaf)
                said = [decode(path, x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(said, pa.string())], ["id", "ids", "decoded"])

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, pieces in enumerate(batch.column(1)):
                pieces = sorted(pieces.as_py(), key=lambda p: p["k"])
                level = [Node([(i["run"], i["ids"]) for i in p["items"]], p["opens"], p["closes"]) for p in pieces]
                ids = b"".join(i for _, i in up(level, _known_runs(path, leaf).__getitem__).items)
                said = decode(path, np.frombuffer(ids, "<u4"))
                for _ in range(pieces[0]["n"]):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([ids], pa.binary()), pa.array([said])], ["id", "ids", "decoded"])

    size = F.char_length("text")
    short = chosen.where(size <= spread).mapInArrow(tidy(run, "bpe"), f"id {kind}, ids binary, decoded string")
    dealt = chosen.where(size > spread).select("id", F.xxhash64("text").alias("th"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{spread}}}"), F.lit(0))).alias("k", "piece"))
    dealt = dealt.groupBy("id", "th", "k").agg(F.count("*").alias("n"), F.first("piece").alias("piece"))
    found = _pieces(dealt, path, leaf).groupBy("id", "th").agg(F.collect_list(F.struct("k", "n", "opens", "closes", "items")).alias("pieces"))
    long = found.select("id", "pieces").mapInArrow(tidy(tops, "bpe"), f"id {kind}, ids binary, decoded string")
    return short.union(long).withColumnRenamed("id", id_col)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.select(
        id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
