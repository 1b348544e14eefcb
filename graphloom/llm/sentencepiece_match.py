"""SentencePiece encoding and decoding by suffix-array matching (operator 6).

The model is of the BPE kind with byte fallback: a text's pieces are what merging neighbours, best score first,
leaves. A segmentation is that result exactly if no pair of neighbouring pieces would have been merged across their
border before they were complete, and every prefix has one last piece for which that holds. So the pieces found in
the text are edges between positions, and edges are relaxed by position: an edge is taken if its start was reached
and its piece may follow the one that reached it.

Texts are cut where no piece of the model holds the two characters beside each other, so nothing is merged across a
cut. Pieces of several word marks all have one score, the worst of all: they are made when everything else is done,
the leftmost first. A run of single marks in the relaxed ids is therefore replaced by the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .pieces import ChunkCache
from .textops import text_slices

SPACE = "▁"
FAR = np.int64(1) << 40
#: Edges that end at one place of their chunks: up to so many are relaxed one by one.
FEW = 24
#: Pairs of pieces in the memory of a worker before it starts anew.
PAIRS = 1 << 20


class Model:
    """Tables of a model: pieces by id, how each was merged, and which neighbours can merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        self.normal = np.ones(n, bool)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.normal[i] = False
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.id = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        # ranks: smaller merges first; pieces of one character are never merged
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = np.where(self.normal, rank.astype(np.int64), 0)
        for i, p in enumerate(self.pieces):
            if len(p) == 1:
                self.rank[i] = -1
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        self.made = np.zeros(n, bool)
        pairs = {}
        for p, i in self.id.items():
            if len(p) == 1:
                self.made[i] = True
                continue
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = int(self.rank[i])
            parts, last = self.merge(p)
            if len(parts) == 1 and last:
                self.made[i], (self.left[i], self.right[i]) = True, last
        self.n = n
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        order = sorted(i for p, i in self.id.items() if self.made[i] and not self._marks(p))
        self.dtype = np.uint16 if n <= 1 << 16 else np.uint32
        self._neighbours()
        self._runs()
        self.search = sorted((self.pieces[i], i) for i in order)
        self.longest = max((len(p) for p, _ in self.search), default=1)
        # bytes of each id when decoded
        blobs = [bytes([int(p[3:5], 16)]) if i in set(self.byte_id.tolist()) else p.replace(SPACE, " ").encode() if self.normal[i] else b"" for i, p in enumerate(self.pieces)]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)

    @staticmethod
    def _marks(p: str) -> bool:
        return len(p) > 1 and set(p) == {SPACE}

    def _neighbours(self) -> None:
        """``beside``: which characters stand beside each other in a piece, by their numbers in ``letter``."""
        inner = [p for p in self.id if len(p) > 1 and not self._marks(p)]
        if any(SPACE in p[1:] for p in inner):
            raise ValueError("a piece has a word mark after its first character")
        known = sorted({c for p in inner for c in p})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        number = {c: k for k, c in enumerate(known, 1)}
        self.beside = np.zeros((len(known) + 1, len(known) + 1), bool)
        for p in inner:
            at = [number[c] for c in p]
            self.beside[at[:-1], at[1:]] = True

    def _runs(self) -> None:
        """``runs[r]``: ids of a run of r marks, r below the longest such piece, which longer runs begin with."""
        marks = sorted((p for p in self.id if self._marks(p)), key=len)
        self.mark, self.run_id, self.runs = self.id.get(SPACE, -1), -1, []
        if not marks:
            return
        others = max((int(self.rank[i]) for p, i in self.id.items() if not self._marks(p)), default=-1)
        if len({int(self.rank[self.id[p]]) for p in marks}) != 1 or self.rank[self.id[marks[0]]] <= others:
            raise ValueError("pieces of several word marks have scores of their own")
        longest = len(marks[-1])
        self.run_id, self.runs = self.id[marks[-1]], [self.merge(SPACE * r)[0] for r in range(longest)]
        for r in range(longest, 3 * longest):
            if self.merge(SPACE * r)[0] != [self.run_id] * (r // longest) + self.runs[r % longest]:
                raise ValueError("runs of word marks are not merged from the left")

    def join_marks(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with each run of single marks replaced by its pieces, and the number of ids of each text."""
        if not self.runs or not len(ids):
            return ids, counts
        alone = ids == self.mark
        text = np.repeat(np.arange(len(counts)), counts)
        follows = alone[1:] & alone[:-1] & (text[1:] == text[:-1])
        if not follows.any():
            return ids, counts
        begins = np.flatnonzero(alone & ~np.concatenate([[False], follows]))
        size = np.diff(np.append(np.flatnonzero(~np.concatenate([[False], follows])), len(ids)))
        size = size[np.searchsorted(np.flatnonzero(~np.concatenate([[False], follows])), begins)]
        longest = len(self.runs)
        rest = [np.array(r, np.int64) for r in self.runs]
        whole, part = size // longest, size % longest
        made = whole + np.array([len(r) for r in rest])[part]
        keep = ~alone
        n_out = np.where(keep, 1, 0)
        n_out[begins] = made
        ends = np.cumsum(n_out)
        out = np.empty(int(ends[-1]), ids.dtype)
        out[ends[keep] - 1] = ids[keep]
        at = ends[begins] - made
        out[np.repeat(at, whole) + np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)] = self.run_id
        at = at + whole
        for r in np.unique(part).tolist():
            for j, i in enumerate(rest[r].tolist()):
                out[at[part == r] + j] = i
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(total)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of chunks in the bytes of texts: places that no piece spans, those of texts included."""
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        letter = self.letter[np.where(code == 0x20, ord(SPACE), code)]
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.beside[letter[:-1], letter[1:]]
        first = offsets[:-1][np.diff(offsets) > 0]
        cut[np.searchsorted(place, first)] = True
        return place[cut]

    def merge(self, text: str) -> tuple[list, tuple | None]:
        """Merging by definition, for the tables of a model: (ids, the last pair merged); characters without a piece stay characters."""
        parts = list(text)
        last = None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if at < 0:
                return [self.id.get(p, p) for p in parts], last
            last = (self.id.get(parts[at], -1), self.id.get(parts[at + 1], -1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Encodes batches of chunks by the model's tables."""

    def __init__(self, model: Model):
        self.m = model
        width = 1
        while width < model.longest:
            width *= 2
        self.width = width
        self.follow_key = np.full(1 << 20, -1, np.int64)
        self.follow_ok = np.zeros(1 << 20, bool)
        self.pairs: dict[int, bool] = {}

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        m = self.m
        k = x * m.n + y
        at = np.minimum(np.searchsorted(m.pair_key, k), len(m.pair_key) - 1)
        return np.where((m.pair_key[at] == k) & (x >= 0) & (y >= 0) & (x < m.n) & (y < m.n), m.pair_rank[at], FAR)

    def may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether piece y may stand after piece x: going back in time, no merge across their border comes first."""
        slot = ((x * np.int64(1000003) + y) * np.int64(-7046029254386353131) >> 44) & ((1 << 20) - 1)
        key = x * (1 << 31) + y
        ok = self.follow_ok[slot]
        todo = np.flatnonzero(self.follow_key[slot] != key)
        if len(todo):
            _, first, inverse = np.unique(key[todo], return_index=True, return_inverse=True)
            rows = todo[first]
            got = self._follow(x[rows], y[rows])
            ok[todo] = got[inverse]
            self.follow_key[slot[rows]], self.follow_ok[slot[rows]] = key[rows], got
            # slots shared by two pairs hold the last of them, with its own answer
            clash = self.follow_key[slot[rows]] != key[rows]
            if clash.any():
                order = np.flatnonzero(~clash)
                self.follow_ok[slot[rows[order]]] = got[order]
        return ok

    def _follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        m = self.m
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), FAR - 1)
        ok = np.ones(len(x), bool)
        live = np.arange(len(x))
        rank = np.append(m.rank, -1)
        left, right = np.append(m.left, -1), np.append(m.right, -1)
        while len(live):
            a, b = np.minimum(x[live], m.n), np.minimum(y[live], m.n)
            bad = self._pair_rank(a, b) < limit[live]
            ok[live[bad]] = False
            live, a, b = live[~bad], a[~bad], b[~bad]
            done = (rank[a] < 0) & (rank[b] < 0)
            live, a, b = live[~done], a[~done], b[~done]
            back = rank[a] > rank[b]
            limit[live] = np.where(back, rank[a], rank[b] + 1)
            x[live] = np.where(back, right[a], a)
            y[live] = np.where(back, b, left[b])
        return ok

    def _suffixes(self, code: np.ndarray) -> np.ndarray:
        """Suffix array of the characters, by their first ``width``: ranks doubled until that length."""
        _, rank = np.unique(code, return_inverse=True)
        rank, h, n = rank.astype(np.int64), 1, len(code)
        order = np.argsort(rank, kind="stable")
        while h < self.width:
            nxt = np.zeros(n, np.int64)
            nxt[:-h] = rank[h:] + 1 if h < n else 0
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            k = key[order]
            step = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = step
            h *= 2
        return order

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece in the text, sorted by end, then start."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        order = self._suffixes(code)
        n = len(code)
        padded = np.concatenate([code, np.zeros(self.width, np.uint32)])
        lo, hi = np.zeros(len(self.m.search), np.int64), np.full(len(self.m.search), n, np.int64)
        lens = np.array([len(p) for p, _ in self.m.search], np.int64)
        ids = np.array([i for _, i in self.m.search], np.int64)
        letters = np.zeros((len(lens), self.width), np.uint32)
        for r, (p, _) in enumerate(self.m.search):
            letters[r, : len(p)] = [ord(c) for c in p]
        # narrow every piece's range by one character after another, by binary search inside the range
        for j in range(self.width):
            rows = np.flatnonzero((lens > j) & (lo < hi))
            if not len(rows):
                break
            want = letters[rows, j]
            lo[rows], hi[rows] = self._bound(order, padded, lo[rows], hi[rows], j, want, False), self._bound(order, padded, lo[rows], hi[rows], j, want, True)
        count = np.maximum(hi - lo, 0)
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        start = order[at]
        end = start + np.repeat(lens, count)
        piece = np.repeat(ids, count)
        by = np.argsort(end * np.int64(64) + (end - start), kind="stable")
        return start[by], end[by], piece[by]

    @staticmethod
    def _bound(order, padded, lo, hi, j, want, after):
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            c = padded[order[mid] + j]
            less = c <= want[open_] if after else c < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, the number of each)."""
        texts = [c.decode().replace(" ", SPACE) for c in chunks]
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        return self._relax("\0".join(texts) + "\0", base, sizes)

    def _relax(self, text: str, base: np.ndarray, sizes: np.ndarray):
        m = self.m
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(code)
        word = np.repeat(np.arange(len(base)), sizes + 1)
        start, end, piece = self.edges(text)
        inside = end <= (base + sizes)[word[start]]
        start, end, piece = start[inside], end[inside], piece[inside]
        # a character without a piece is an edge of its own, beyond the model's ids
        have = np.zeros(n, bool)
        have[start[end == start + 1]] = True
        newline = np.zeros(n, bool)
        newline[base + sizes] = True
        lone = np.flatnonzero(~have & ~newline)
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, m.n + code[lone].astype(np.int64)])
        local = end - base[word[start]]
        by = np.argsort(local, kind="stable")
        start, end, piece, local = start[by], end[by], piece[by], local[by]
        reached = np.full(n + 1, -2, np.int64)
        before = np.zeros(n + 1, np.int64)
        reached[base] = -1
        cuts = np.flatnonzero(np.diff(local, prepend=-1, append=-1))
        cuts = cuts.tolist()
        few = next((k for k in range(len(cuts) - 1) if len(cuts) - 1 - k > 0 and cuts[k + 1] - cuts[k] <= FEW), len(cuts) - 1)
        for a, b in zip(cuts[:few], cuts[1 : few + 1], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            prev = reached[s]
            ok = prev == -1
            more = np.flatnonzero(prev >= 0)
            ok[more] = self.may_follow(prev[more], p[more])
            reached[e[ok]], before[e[ok]] = p[ok], s[ok]
        if few < len(cuts) - 1:
            a = cuts[few]
            self._one_by_one(start[a:], end[a:], piece[a:], reached, before)
        return self._traced(base, sizes, reached, before)

    def _one_by_one(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, reached: np.ndarray, before: np.ndarray) -> None:
        """Relax what is left, where few chunks are so long: pairs met before are looked up. Sorted by place in the chunk."""
        m, known, found = self.m, self.pairs, {}
        if len(known) > PAIRS:
            known.clear()
        if len(start):
            lo = int(start.min())
            held, back = reached[lo:].tolist(), before[lo:].tolist()
            for s, e, p in zip((start - lo).tolist(), (end - lo).tolist(), piece.tolist(), strict=True):
                prev = held[s]
                if prev == -2:
                    continue
                if prev >= 0:
                    # characters without a piece are alike: nothing merges with them
                    pair = min(prev, m.n) * (m.n + 1) + min(p, m.n)
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = bool(self._follow(np.array([prev]), np.array([p]))[0])
                    if not ok:
                        continue
                held[e], back[e] = p, s + lo
            reached[lo:], before[lo:] = held, back

    def _traced(self, base: np.ndarray, sizes: np.ndarray, reached: np.ndarray, before: np.ndarray):
        """(ids of all chunks, the number of each): from every end back to the start, all chunks at once."""
        m = self.m
        at, which, steps = base + sizes, np.arange(len(base)), []
        while len(at):
            live = at > base[which]
            at, which = at[live], which[live]
            if len(at):
                steps.append((which, at))
                at = before[at]
        if not steps:
            return np.zeros(0, m.dtype), np.zeros(len(base), np.int32)
        ends = np.sort(np.concatenate([a for _, a in steps]))
        got = reached[ends]
        lone = got >= m.n
        raw = "".join(map(chr, (got[lone] - m.n).tolist()))
        wide = np.ones(len(got), np.int64)
        wide[lone] = [len(c.encode()) for c in raw]
        flat = np.repeat(got, wide)
        flat[np.repeat(lone, wide)] = m.byte_id[np.frombuffer(raw.encode(), np.uint8)]
        chunk = np.searchsorted(base, ends, "left") - 1
        lens = np.bincount(chunk, weights=wide, minlength=len(base)).astype(np.int32)
        return flat.astype(m.dtype), lens


_encoders: dict = {}


def _cache(path: str, model: Model) -> ChunkCache:
    if path not in _encoders:
        _encoders[path] = ChunkCache(Encoder(model).encode, model.dtype, model.cuts)
    return _encoders[path]


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.insert(data, offsets[:-1][full], 0x20)
    shift = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    return out, offsets + shift


def decode(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each) of ids; the space before a text is taken off."""
    sizes = np.diff(model.blob_at)[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ids) else 0
    data = model.blob[np.arange(total) + np.repeat(model.blob_at[:-1][ids] - (ends - sizes), sizes)]
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    full = np.flatnonzero(np.diff(at) > 0)
    mark = at[:-1][full]
    lead = mark[data[mark] == 0x20] if len(mark) else mark
    gone = np.zeros(len(at), np.int64)
    gone[1:] = np.cumsum(np.isin(at[:-1], lead) & (np.diff(at) > 0))
    return np.delete(data, lead), at - gone


def _run(path: str, shared):
    def run(batches):
        model = shared.value
        cache = _cache(path, model)
        for b in batches:
            for first, last, data, offsets in text_slices(b.column(1)):
                marked = _marked(data, offsets)
                ids, n = model.join_marks(*cache.ids(*marked))
                back, at = decode(model, ids.astype(np.int64), n)
                same = np.array([back[at[i] : at[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(last - first)])
                texts = pa.LargeStringArray.from_buffers(last - first, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(back.tobytes())).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), lists, texts, pa.array(same)], ["doc_id", "ids", "decoded", "same"])

    return run


_models: dict[str, Model] = {}


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded, same) for every row of ``docs`` (doc_id, text); ``model`` is a file on the driver.

    ``ids`` equal those of the SentencePiece library for the whole text; ``decoded`` is made from them; ``same``
    tells whether it is the text again. A literal word mark (U+2581) in a text decodes to a space. Null and empty
    texts have no ids. Repeated rows give equal rows; other columns are ignored. A map without a shuffle: each
    worker matches only chunks that it has not met, in a cache of bounded size.
    """
    spark = docs.sparkSession
    prepare(spark)
    if model not in _models:
        _models[model] = Model(model)
    shared = spark.sparkContext.broadcast(_models[model])
    return docs.select("doc_id", "text").mapInArrow(_run(model, shared), "doc_id long, ids array<int>, decoded string, same boolean")


def digest(ids) -> int:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
