"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target token proportions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .textops import _INVERSE, _PRIME, _powers, mix, small_batches

SEQUENCE = 2048
#: Sequences of a window, over which the proportions are kept; a window has one for each source, if these are more.
WINDOW = 64
#: Rows of about 40 bytes that are still sent to all tasks.
MOST_BASES = 200_000
END_ID = 1
CACHE_WORDS = 400_000
#: Characters of a piece in which longer texts are encoded.
PIECE = 1 << 19
LONG_WORD = 64
_CONTRACTION = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Classes of the code points up to 0x24F, of which all Unicode versions say the same.
_KNOWN = 0x250


def _classes() -> np.ndarray:
    out = np.full(_KNOWN, _OTHER, np.uint8)
    for i in range(_KNOWN):
        c = chr(i)
        if regex.match(r"\p{L}", c):
            out[i] = _LETTER
        elif regex.match(r"\p{N}", c):
            out[i] = _NUMBER
        elif regex.match(r"\s", c):
            out[i] = _SPACE
    return out


def _byte_of() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids as the byte-level BPE tokenizer of a file gives them. Words are split in numpy and looked up by hash; those not
    met before are merged together by a faster BPE over the file's own vocabulary, to the same ids. Texts that the split does
    not cover (characters from 0x250, contractions) go to the tokenizer itself, whole."""

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        back, special = _byte_of(), {x["content"] for x in told.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in w): i for w, i in told["model"]["vocab"].items() if w not in special}
        pattern = r""" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.line = self.bpe.encode_ordinary("\n")[0]
        self.cls = _classes()
        self.clear()

    def clear(self) -> None:
        self.bits = 21
        self.slot_hash = np.zeros(1 << self.bits, np.uint64)
        self.slot_entry = np.full(1 << self.bits, -1, np.int32)
        self.start, self.length, self.words = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.ids, self.used = np.zeros(1 << 18, np.uint16), 0

    def whole(self, text: str) -> np.ndarray:
        return self.wholes([text])[0]

    def wholes(self, texts: list[str]) -> list[np.ndarray]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True
        return [np.array(x.ids, np.uint16) for x in self._whole.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after the other, and their numbers. Words go in one text, a line each: a line end is a word and
        an id of its own, and no other word has it, white space aside."""
        white = [i for i, w in enumerate(words) if w.isspace()]
        n = np.zeros(len(words), np.int32)
        ids = np.array(self.bpe.encode_ordinary("\n".join(w for w in words if not w.isspace()) + "\n"), np.uint16)
        ends = np.flatnonzero(ids == self.line)
        n[[i for i, w in enumerate(words) if not w.isspace()]] = np.diff(np.r_[-1, ends])[: len(words) - len(white)] - 1
        ids = ids[ids != self.line]
        if white:
            at, parts, done = np.cumsum(n) - n, [], 0
            for i in white:
                own = np.array(self.bpe.encode_ordinary(words[i]), np.uint16)
                parts += [ids[done : at[i]], own]
                done, n[i] = at[i], len(own)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, n

    def _add(self, words: list[str]) -> np.ndarray:
        got, n = self._merge(words)
        while self.words + len(n) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(got) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        at = np.arange(self.words, self.words + len(n))
        self.length[at] = n
        self.start[at] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(got)] = got
        self.used += len(got)
        self.words += len(n)
        return at.astype(np.int32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that the split covers."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(cp) + 1, bool)
        first[0] = True
        first[ends] = True
        c = self.cls[cp]
        before = np.r_[np.uint8(9), c[:-1]]
        before[first[:-1]] = 9
        blank = np.r_[False, cp[:-1] == 32] & ~first[:-1]  # the character before is a plain space of this text
        space = c == _SPACE
        after = np.r_[c[1:], np.uint8(_SPACE)]
        last = space & (after != _SPACE) & ~np.r_[first[1:-1], True]  # ends a run of white space that text follows
        start = np.where(space, last | (before != _SPACE), (before != c) & ~blank)
        s = np.flatnonzero(start)
        e = np.r_[s[1:], len(cp)]
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * _powers("up", _PRIME, len(cp)), out=total[1:])
        h = mix((total[e] - total[s]) * _powers("down", _INVERSE, len(cp) + 1)[s] + (e - s).astype(np.uint64))
        slot = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        entry = np.where(self.slot_hash[slot] == h, self.slot_entry[slot], -1)
        miss = np.flatnonzero((entry < 0) | (e - s > LONG_WORD))  # long words are never told by their hash
        if len(miss):
            long = e[miss] - s[miss] > LONG_WORD
            key, one, back = np.unique(np.where(long, h[miss] ^ s[miss].astype(np.uint64), h[miss]), return_index=True, return_inverse=True)
            made = self._add([joined[s[i] : e[i]] for i in miss[one]])
            entry[miss] = made[back]
            short = one[~long[one]]
            self.slot_hash[slot[miss[short]]] = h[miss[short]]
            self.slot_entry[slot[miss[short]]] = entry[miss[short]]
        n = self.length[entry].astype(np.int64)
        at = np.cumsum(n) - n
        out = self.ids[np.repeat(self.start[entry] - at, n) + np.arange(int(n.sum()))]
        tokens = np.r_[at, n.sum()][np.searchsorted(s, ends)]
        if self.words > CACHE_WORDS:
            self.clear()
        return np.split(out, tokens[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids. Long texts are cut where it changes nothing, so memory follows PIECE, not the longest text."""
        made: list[list[np.ndarray]] = [[] for _ in texts]
        for covered, encode in ((True, self.plain), (False, self.wholes)):
            group, size = [], 0
            for i, t in enumerate(texts):
                for piece in _cuts(t) if _covered(t) == covered else ():
                    if group and size + len(piece) > PIECE:
                        self._flush(made, group, encode)
                        group, size = [], 0
                    group.append((i, piece))
                    size += len(piece)
            if group:
                self._flush(made, group, encode)
        return [m[0] if len(m) == 1 else np.concatenate(m or [np.zeros(0, np.uint16)]) for m in made]

    @staticmethod
    def _flush(made: list, group: list, encode) -> None:
        for (i, _), ids in zip(group, encode([piece for _, piece in group]), strict=True):
            made[i].append(ids)


_CUT = regex.compile(r"(?<=\S) ")


def _cuts(text: str):
    """Pieces of a text of about PIECE characters, cut before a space that follows something else: there a word always ends."""
    at = 0
    while len(text) - at > PIECE:
        m = _CUT.search(text, at + PIECE)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:]


def _covered(t: str) -> bool:
    if "'" in t and _CONTRACTION.search(t):
        return False
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        if max(t) >= chr(_KNOWN):
            return False
    return True


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenize(path: str, end_id: int):
    def run(batches):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        seen: dict = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            end = np.array([end_id], np.uint16).tobytes()
            ids = [x.tobytes() + end for x in _TOKENIZERS[path].encode(texts)]
            at = np.zeros(len(ids), np.int64)
            for i, q in enumerate(batch.column("queue").to_pylist()):
                at[i] = seen.get(q, 0)
                seen[q] = int(at[i]) + len(ids[i]) // 2
            arrays = [batch.column("doc_id"), batch.column("queue"), batch.column("part"), pa.array(at), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "queue", "part", "at", "n", "ids"])

    return run


class Rounds:
    """Where each token of each queue goes. Queue q's tokens per window are its share of the window; the fraction that a
    window cannot serve is carried as a deficit, so that after k windows a queue has been served floor(k * share) tokens. A
    window holds the queues' turns in order; all is a formula of the queues' totals, hence the same in every partition."""

    def __init__(self, totals: list[int], window: int = WINDOW * SEQUENCE, weights: list[float] | None = None):
        self.total = np.array(totals, np.int64)
        self.window = window
        self.rate = np.array(weights if weights is not None else totals, np.float64)
        # a queue is exhausted at the virtual time total / rate; active() is the tokens that all queues have given by then
        end = np.where(self.rate > 0, self.total / np.maximum(self.rate, 1e-300), 0.0)
        order = np.argsort(end, kind="stable")
        self.time = np.r_[0.0, end[order]]
        left = self.rate.sum() - np.r_[0.0, np.cumsum(self.rate[order])[:-1]]
        self.given = np.r_[0.0, np.cumsum(np.diff(self.time) * np.maximum(left, 0))]

    def served(self, k) -> np.ndarray:
        """Tokens served to each queue in the first k windows, shape (windows, queues)."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        whole = k * self.window >= self.total.sum()
        v = np.interp(k * float(self.window), self.given, self.time)
        out = np.minimum(self.total[None, :], np.floor(v[:, None] * self.rate[None, :] + 1e-9).astype(np.int64))
        out[whole] = self.total
        return out

    def pieces(self, queue: int, at: int, n: int):
        """(start, length, place) runs of n tokens from `at` in the queue, place being where they stand in the whole stream."""
        done = 0
        v = at / self.rate[queue] if self.rate[queue] > 0 else 0.0
        k = max(0, int(np.interp(v, self.time, self.given) / self.window) - 1)
        while done < n:
            now, nxt = self._turn(k), self._turn(k + 1)
            if at + done >= nxt[0][queue]:
                k += 1
                continue
            length = min(n - done, int(nxt[0][queue]) - at - done)
            ahead = int(nxt[1][queue] - now[1][queue])  # turns of the queues before this one in the window
            yield done, length, int(now[2]) + ahead + at + done - int(now[0][queue])
            done += length

    def _turn(self, k: int):
        if not hasattr(self, "_kept"):
            self._kept: dict = {}
        if k not in self._kept:
            if len(self._kept) * len(self.total) > 1 << 20:  # places are asked for in the order of windows
                self._kept.clear()
            s = self.served(k)[0]
            self._kept[k] = (s, np.cumsum(s) - s, s.sum())
        return self._kept[k]


def _pieces(totals: list[int], length: int, window: int, weights):
    def run(batches):
        rounds = Rounds(totals, window, weights)
        for batch in batches:
            cols: list = [[] for _ in range(7)]
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "rank", "at", "n", "ids")], strict=True))
            # in the order of windows, as a window's turns are computed once for all its rows
            for doc, q, at, n, raw in sorted(rows, key=lambda r: r[2] / max(totals[r[1]], 1)):
                ids = np.frombuffer(raw, np.uint16).astype("<u4")
                for start, size, place in rounds.pieces(q, at, n):
                    while size:
                        take = min(size, length - place % length)
                        piece = (doc, start, take, zlib.crc32(ids[start : start + take]), n, place // length, place % length)
                        for c, x in zip(cols, piece, strict=True):
                            c.append(x)
                        start, size, place = start + take, size - take, place + take
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, window: int | None = None, end_id: int = END_ID, weights: dict | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document in a sequence.

    Every source, however many there are, is a queue of its documents' tokens, each document ending with end_id. Windows are
    filled by rounds over the queues to the proportions of `weights` (by source, 1 for those not named; by default the
    sources' own tokens, so that all queues end together); a queue that ends early leaves its share to the others. A window
    has `window` tokens; by default WINDOW sequences, or one a source if these are more. All sequences are full but the last.
    A null or empty text is the end id alone; a null source is a queue of its own; repeated rows are packed each; an empty
    table gives an empty result; other columns are ignored. Token ids are kept once, in the shared folder, in the order they
    were read. Every task holds the queues' totals, 24 bytes a source.
    """
    spark = docs.sparkSession
    small_batches(spark)
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("queue")
    rows = docs.select("doc_id", queue, F.spark_partition_id().alias("part"), "text")
    shape = "doc_id long, queue string, part int, at long, n long, ids binary"
    ids = materialize(rows.mapInArrow(_tokenize(tokenizer, end_id), shape), "pack-ids")
    sums = materialize(ids.groupBy("queue", "part").agg(F.sum("n").alias("n")), "pack-sums")
    totals = sorted((r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    rank = {q: i for i, (q, _) in enumerate(totals)}
    share = None if weights is None else [float(weights.get(q[1:] if q[0] == "s" else None, 1.0)) for q, _ in totals]
    tokens = window or length * max(WINDOW, len(totals))
    # where each part's tokens begin in its queue: a running sum over parts, of which each queue has as many as the input
    before = F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")
    ranks = spark.createDataFrame(list(rank.items()) or [("null", 0)], "queue string, rank int")
    bases = sums.withColumn("before", before).select("queue", "part", "before").join(ranks, "queue")
    # one row per queue and part of the input: sent to all tasks while small, so that ids stay where they are, else joined
    bases = F.broadcast(bases) if sums.count() <= MOST_BASES else bases
    placed = ids.join(bases, ["queue", "part"]).select("doc_id", "rank", (F.col("at") + F.col("before")).alias("at"), "n", "ids")
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_pieces([n for _, n in totals], length, tokens, share), shape)


def op8_mixture_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
