"""N-gram Jaccard join: documents whose sets of word shingles overlap enough,
and the components that these links form.

Exact throughout: no sketches, no caps.

1. A scan hashes each text's shingles to 64 bits. Texts of equal sets within a
   batch are one; a batch sends its shingles, sorted, to ranges of hash values.
2. A range counts in how many texts each shingle occurs and answers the batches
   that hold it, if that is more than one. Shingles in one text only can't be
   shared, so most texts end here: a text can only have a partner if fewer
   than its prefix of rarest shingles are its own alone.
3. The texts left are tied to others of equal prefix shingles, a star for each
   shingle. The components of these ties hold every link.
4. Each such group is searched by T-occurrence: an inverted index over the
   shared shingles of its texts; for each text the L longest of its lists are
   set aside, the short ones are merged by a heap of their runs, candidates found
   often enough are looked up in the long lists by binary search, and those
   reaching the required overlap are links (DivideSkip). Lists leave out texts that
   are already in the text's component. In a group beyond a task's memory, texts are
   first held against a few hubs, which ties most of a large group of near copies
   in passes over its rows; its largest part and the rest are then searched as
   pairs of blocks, a task each, but for pairs within the largest part.

A batch sends each shingle once: with the text that holds it, or with the number
of its texts, where which ones they are stays in a side list of the batch. So the
rows of the hottest shingle are no more than there are batches. Groups of equal
sets meet only in salted aggregations.

Shingles are compared by 64-bit hashes of their words. Two shingles that share a
hash could add one to an overlap; among n different shingles that is expected to
happen n**2 / 2**65 times (0.03 times in a billion), and a link is wrong only where
such a pair also lies at the threshold.

Null texts and texts without words have the empty set and no links. Rows that
repeat a doc_id count as documents of their own and get the same component; rows
without doc_id take the component of an equal text that has one, else none. Texts are
hashed whole, of any length, each within one task. Only the two named columns are
read, which must be unambiguous in any case of letters; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as dataset
import xxhash
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from packlake.llm import common
from packlake.llm.components import components

WORDS, SIMILARITY = 5, 75
#: A batch of the scan closes at so many shingles or texts.
BATCH_SHINGLES, BATCH_TEXTS = 1_400_000, 60_000
#: Stands for the texts of a side list.
SIDE = 0xFFFF
#: In a larger group, texts are held against so many hubs, in so many rounds.
HUBS, HUB_ROUNDS = 16, 4
#: Texts with more copies than this are joined to their component by salts.
MANY_COPIES = 10_000
#: Shingles of a range, and of a group that one task searches.
RANGE_SHINGLES, GROUP_SHINGLES = 800_000, 1_000_000
#: Texts of a run, which the merge of lists counts at once.
SPAN = 4096
#: Lookups of candidates in long lists that are made at once.
PROBES = 4096

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def need(size: int, other: int, percent: int = SIMILARITY) -> int:
    """Least overlap of sets of these sizes that links them."""
    return -(-percent * (size + other) // (100 + percent))


def prefix(size: int, percent: int = SIMILARITY) -> int:
    """So many of a set's shingles, in one order of all shingles, hold one that
    every partner holds in its own prefix."""
    return size - -(-percent * size // 100) + 1


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        found = text.lower().split()  # on bytes: A-Z only, and the six ASCII white spaces
        if not found:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64) if k < self.words else np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * MIX[i % len(MIX)]
            if self.words > len(MIX):
                out ^= out >> np.uint64(29)
        out ^= out >> np.uint64(32)
        out *= MIX[3]
        out ^= out >> np.uint64(29)
        return np.unique(out)


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as bytes: the differences of the high halves, then the low halves."""
    high = (h >> np.uint64(32)).astype("<u4")
    return np.diff(high, prepend=np.uint32(0)).astype("<u4").tobytes() + (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    half = np.frombuffer(data, "<u4").astype(np.uint64)
    n = len(half) // 2
    return (np.cumsum(half[:n]) << np.uint64(32)) | half[n:]


MESSAGE = "kind string, range long, batch long, hashes binary, texts binary, docs binary"
DOCUMENT = [("doc_id", "<i8"), ("null", "u1"), ("text", "<u4")]


def _scan(docs: DataFrame, ranges: int, words: int) -> DataFrame:
    """Messages of the batches. kind p: postings for a range; d: the batch's own
    row with its documents, its texts' sizes and signatures, and side lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, number = Shingler(words), TaskContext.get().partitionId() << 24
        schema = pa.schema([("kind", pa.string()), ("range", pa.int64()), ("batch", pa.int64()), ("hashes", pa.binary()), ("texts", pa.binary()), ("docs", pa.binary())])
        sets: list[np.ndarray] = []
        seen: dict[bytes, int] = {}
        members: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sets, seen, members, held, number
            if not members:
                return
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            text = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(flat, kind="stable")
            flat, text = flat[order], text[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
            runs = np.diff(np.append(first, len(flat)))
            many = runs > 1
            inside = np.repeat(many, runs)
            side = flat[first[many]].astype("<u8").tobytes() + runs[many].astype("<u4").tobytes() + text[inside].astype("<u2").tobytes()
            flat, text, sent = flat[first], np.where(many, np.uint16(SIDE), text[first]), np.where(many, runs, 0).astype("<u2")
            # ranges cut the hashes evenly, so a shingle's range follows from its high half
            place = ((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(flat) else np.zeros(0, np.int64)
            rows: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(flat)], strict=False):
                t = text[a:b]
                rows.append(("p", int(place[a]), number, pack_sorted(flat[a:b]), t.astype("<u2").tobytes(), sent[a:b][t == SIDE].tobytes()))
            signature = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            own = np.array(members, dtype=DOCUMENT).tobytes()
            head = np.array([len(sets), int(many.sum())], "<i8").tobytes()
            rows.append(("d", number % ranges, number, zlib.compress(head + sizes.astype("<i8").tobytes() + signature, 1), zlib.compress(side, 1), zlib.compress(own, 1)))
            for at in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 16], strict=True), schema, strict=True)], schema=schema)
            sets, seen, members, held, number = [], {}, [], 0, number + 1

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingler(value.as_py() or b"")
                if not len(s):
                    members.append((key or 0, key is None, 0xFFFFFFFF))
                else:
                    mark = s.tobytes() if len(s) < 4 else xxhash.xxh3_128_digest(s.tobytes())
                    at = seen.setdefault(mark, len(sets))
                    if at == len(sets):
                        sets.append(s)
                        held += len(s)
                    members.append((key or 0, key is None, at))
                if held >= BATCH_SHINGLES or len(sets) >= BATCH_TEXTS or len(members) >= 8 * BATCH_TEXTS:
                    yield from flush()
        yield from flush()
        shingler.known.clear()
        common.release()

    return docs.mapInArrow(run, MESSAGE)


def _trimmed(run: Callable[[pd.DataFrame], pd.DataFrame], least: int = 0) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``run``, after which groups of at least so many shared bytes leave no memory behind."""

    def trimmed(frame: pd.DataFrame) -> pd.DataFrame:
        large = not least or int(frame["shared"].str.len().sum()) >= least
        out = run(frame)
        if large:
            common.release()
        return out

    return trimmed


def _count(messages: DataFrame) -> DataFrame:
    """By range: answers (kind a) to each batch with its shared shingles, in how
    many texts each occurs, and who holds it; rows of kind d pass through."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["kind"] == "d"]
        posts = frame[frame["kind"] == "p"].sort_values("batch")
        if posts.empty:
            return own
        hashes = [unpack_sorted(x) for x in posts["hashes"]]
        texts = [np.frombuffer(x, "<u2") for x in posts["texts"]]
        flat, text = np.concatenate(hashes), np.concatenate(texts)
        part = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(first) - 1
        weight = np.ones(len(text), np.int64)
        weight[text == SIDE] = np.concatenate([np.frombuffer(x, "<u2") for x in posts["docs"]])
        weight = weight[order]
        count = np.bincount(group, weight).astype(np.int64)[group]
        shared = count > 1
        order, count = order[shared], np.minimum(count[shared], 0xFFFFFFFF)
        by_part = np.argsort(part[order], kind="stable")
        order, count = order[by_part], count[by_part]
        ends = np.searchsorted(part[order], np.arange(len(hashes) + 1))
        batch = posts["batch"].to_numpy()
        rows = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                at = order[a:b]
                rows.append(("a", -1, batch[i], pack_sorted(flat[at]), text[at].astype("<u2").tobytes(), count[a:b].astype("<u4").tobytes()))
        found = pd.DataFrame(rows, columns=["kind", "range", "batch", "hashes", "texts", "docs"])
        return pd.concat([own, found], ignore_index=True) if rows else own

    return messages.groupBy("range").applyInPandas(_trimmed(run), MESSAGE)


TEXT = "doc_id long, n_shingles long, signature binary, shared binary, prefix binary"


def _texts(answers: DataFrame, percent: int) -> DataFrame:
    """One row per document with size and signature. The first document of a
    text that may have partners carries its shared shingles and the prefix."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["kind"] == "d"].iloc[0]
        told = frame[frame["kind"] == "a"].sort_values("hashes")
        head = zlib.decompress(own["hashes"])
        n, sided = np.frombuffer(head, "<i8", 2).tolist()
        sizes = np.frombuffer(head, "<i8", n, 16)
        signature = head[16 + 8 * n :]
        members = np.frombuffer(zlib.decompress(own["docs"]), DOCUMENT)
        shared: dict[int, tuple[bytes, bytes]] = {}
        if len(told):
            h = np.concatenate([unpack_sorted(x) for x in told["hashes"]])
            t = np.concatenate([np.frombuffer(x, "<u2") for x in told["texts"]]).astype(np.int64)
            c = np.concatenate([np.frombuffer(x, "<u4") for x in told["docs"]]).astype(np.int64)
            if sided:
                side = zlib.decompress(own["texts"])
                side_hash, held = np.frombuffer(side, "<u8", sided), np.frombuffer(side, "<u4", sided, 8 * sided).astype(np.int64)
                side_text = np.frombuffer(side, "<u2", -1, 12 * sided)
                marks = np.flatnonzero(t == SIDE)
                marks = marks[np.argsort(h[marks])]  # each shingle of the side list is shared, so each was answered
                keep = t != SIDE
                h, t, c = np.concatenate([h[keep], np.repeat(side_hash, held)]), np.concatenate([t[keep], side_text]), np.concatenate([c[keep], np.repeat(c[marks], held)])
            order = np.lexsort((h, c, t))
            h, t = h[order], t[order]
            ends = np.searchsorted(t, np.arange(n + 1))
            for i in range(n):
                size, some = int(sizes[i]), int(ends[i + 1] - ends[i])
                most = prefix(size, percent) - (size - some)
                if most > 0 and some:
                    mine = h[ends[i] : ends[i + 1]]
                    shared[i] = (np.sort(mine).astype("<u8").tobytes(), mine[:most].astype("<u8").tobytes())
        given: set[int] = set()
        rows: list[tuple] = []
        for key, null, at in members.tolist():
            key = None if null else key
            if at == 0xFFFFFFFF:
                rows.append((key, 0, None, None, None))
                continue
            lists = shared.get(at, (None, None)) if at not in given else (None, None)
            given.add(at)
            rows.append((key, int(sizes[at]), signature[16 * at : 16 * at + 16], *lists))
        return pd.DataFrame(rows, columns=["doc_id", "n_shingles", "signature", "shared", "prefix"]).astype({"doc_id": "Int64"})

    return answers.groupBy("batch").applyInPandas(_trimmed(run), TEXT)


class Links:
    """T-occurrence search over the texts of a group, smallest first."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int = SIMILARITY, parts: np.ndarray | None = None):
        order = np.lexsort((ids, sizes))
        self.ids, self.sizes, self.percent = ids[order], sizes[order], percent
        sets = [sets[i] for i in order]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        known, self.token = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), np.diff(self.starts))
        by_token = np.argsort(self.token, kind="stable")
        self.posts = owner[by_token]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(self.token, minlength=len(known)))]).astype(np.int64)
        self.places = self.token[by_token] * len(sets) + self.posts  # ascending: each list's place among all
        self.root = np.arange(len(sets))
        if parts is not None:  # texts of equal parts are known to be joined
            _, first, part = np.unique(parts[order], return_index=True, return_inverse=True)
            self.root = first[part]

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True

    def tokens(self, x: int) -> np.ndarray:
        return self.token[self.starts[x] : self.starts[x + 1]]

    def overlap(self, x: int, y: int) -> int:
        return len(np.intersect1d(self.tokens(x), self.tokens(y), assume_unique=True))

    def linked(self, x: int, y: int) -> bool:
        return self.overlap(x, y) >= need(int(self.sizes[x]), int(self.sizes[y]), self.percent)

    def candidates(self, x: int, low: int, high: int, skip: int) -> Iterator[int]:
        """Texts y in [low, high) that link with x, but for those whose root is ``skip``."""
        tokens = self.tokens(x)
        # texts lie by size, so no y needs less than the first one
        threshold = need(int(self.sizes[x]), int(self.sizes[low]), self.percent)
        if len(tokens) < threshold:
            return
        lengths = self.lists[tokens + 1] - self.lists[tokens]
        by_length = np.argsort(lengths, kind="stable")
        tokens, lengths = tokens[by_length], lengths[by_length]
        # the L longest lists are set aside; L = T - 1 leaves the prefix alone
        aside = min(threshold - 1, int(threshold / (0.01 * np.log2(int(lengths[-1]) + 1) + 1)))
        short, long = tokens[: len(tokens) - aside], tokens[len(tokens) - aside :]
        # the short lists end to end, without texts that needn't be sought
        n = lengths[: len(short)]
        ends = np.cumsum(n)
        posts = self.posts[np.arange(ends[-1]) + np.repeat(self.lists[short] - (ends - n), n)]
        open_ = np.flatnonzero((posts >= low) & (posts < high) & (self.flat_root[posts] != skip))
        for ys, counts in self.merged(posts[open_], np.searchsorted(open_, ends)):
            required = self.needs(x, ys)
            often = np.flatnonzero(counts + aside >= required)
            at, some = 0, 64
            while at < len(often):  # after a link, what is joined by it is left out
                take = often[at : at + some]
                at, some = at + some, 2 * some
                take = take[self.flat_root[ys[take]] != self.flat_root[x]]
                if len(take):
                    yield from self.probe(long, ys[take], counts[take], required[take])

    def needs(self, x: int, ys: np.ndarray) -> np.ndarray:
        """``need`` of x and each y."""
        return -(-self.percent * (self.sizes[x] + self.sizes[ys]) // (100 + self.percent))

    def probe(self, long: np.ndarray, ys: np.ndarray, counts: np.ndarray, required: np.ndarray) -> list[int]:
        """Look candidates up in the long lists by binary search, some lists at
        once; those that can't reach the required overlap any more are given up."""
        k, texts = 0, len(self.ids)
        while True:
            open_ = counts + (len(long) - k) >= required
            if not open_.all():
                ys, counts, required = ys[open_], counts[open_], required[open_]
            if not len(ys) or k == len(long) or (counts >= required).all():
                return ys[counts >= required].tolist()
            some = long[k : k + max(1, PROBES // len(ys))]
            sought = some[:, None] * texts + ys
            at = np.minimum(np.searchsorted(self.places, sought), len(self.places) - 1)
            counts = counts + (self.places[at] == sought).sum(axis=0)
            k += len(some)

    @staticmethod
    def merged(values: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge sorted lists, given end to end, by a heap of their runs: what a list
        holds of ``SPAN`` values is one run, and runs of equal values are counted at
        once. Ascending values, with the number of lists that hold each."""
        if not len(values):
            return
        span = values // SPAN
        new = np.concatenate([[True], span[1:] != span[:-1]])
        starts = np.concatenate([[0], ends[:-1]])
        new[starts[starts < ends]] = True
        first = np.flatnonzero(new)
        owner = np.searchsorted(ends, first, side="right").tolist()
        spans, cuts = span[first].tolist(), [*first.tolist(), len(values)]
        heap = [(s, i) for i, s in enumerate(spans) if not i or owner[i] != owner[i - 1]]
        heapq.heapify(heap)
        while heap:
            s, runs = heap[0][0], []
            while heap and heap[0][0] == s:
                i = heap[0][1]
                runs.append(values[cuts[i] : cuts[i + 1]])
                if i + 1 < len(spans) and owner[i + 1] == owner[i]:
                    heapq.heapreplace(heap, (spans[i + 1], i + 1))
                else:
                    heapq.heappop(heap)
            counts = np.bincount(np.concatenate(runs) - s * SPAN)
            found = np.flatnonzero(counts)
            yield found + s * SPAN, counts[found]

    @staticmethod
    def heap(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
        """``merged`` of separate lists; each value with the number of lists that hold it."""
        ends = np.cumsum([len(p) for p in lists], dtype=np.int64)
        for found, counts in Links.merged(np.array([y for p in lists for y in p], np.int64), ends):
            yield from zip(found.tolist(), counts.tolist(), strict=True)

    def run(self) -> list[tuple[int, int]]:
        """Links that join all components, as pairs of ids."""
        out = []
        self.flat_root = self.root.copy()
        links = np.zeros(len(self.ids), np.int64)
        hub: int | None = None
        for x in range(len(self.ids)):
            low = int(np.searchsorted(self.sizes[:x], -(-self.percent * int(self.sizes[x]) // 100)))
            if low >= x:
                continue
            skip = int(self.flat_root[x])
            # most of a large group links with its hub, the text of most links;
            # then only texts of other components are left to seek
            if hub is not None and hub >= low and self.flat_root[hub] != skip and self.linked(x, hub):
                self.merge(x, hub, out)
                skip = int(self.flat_root[x])
                links[hub] += 1
            for y in self.candidates(x, low, x, skip):
                links[y] += 1
                if hub is None or links[y] > links[hub]:
                    hub = y
                self.merge(x, y, out)
        return out

    def merge(self, x: int, y: int, out: list[tuple[int, int]]) -> None:
        """Note a link and join the components of its ends."""
        old = {int(self.flat_root[x]), int(self.flat_root[y])}
        if self.union(x, y):
            out.append((int(self.ids[y]), int(self.ids[x])))
            new = self.find(x)
            for r in old - {new}:
                self.flat_root[self.flat_root == r] = new


def _search(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links of each group, or of each of its block pairs."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("id")
        sets = [np.frombuffer(x, "<u8").astype(np.uint64) for x in frame["shared"]]
        found = Links(frame["id"].to_numpy(np.int64), frame["n_shingles"].to_numpy(np.int64), sets, percent, frame["part"].to_numpy(np.int64)).run()
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return groups.groupBy(*keys).applyInPandas(_trimmed(run, 100_000), "u long, v long")


def classes(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    if words > len(MIX) * 8:
        raise ValueError("shingles of so many words aren't supported")
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(common.partitions(spark), -(-volume // (6 * RANGE_SHINGLES)))
    found = common.stage(_texts(_count(_scan(rows, ranges, words)), percent), "jaccard-texts")

    members = common.group_min(found.where("signature is not null").select("doc_id", "n_shingles", "signature"), ["signature"], "doc_id", "id", "copies")
    members = common.stage(members, "jaccard-members")
    named = members.where("id is not null").groupBy("signature").agg(F.min("id").alias("id"), F.min("copies").alias("copies"))
    partners = found.where("prefix is not null").groupBy("signature").agg(F.min(F.struct("n_shingles", "shared", "prefix")).alias("t"))
    partners = common.stage(partners.join(named, "signature").select("id", "copies", "t.*"), "jaccard-partners")

    posts = partners.select("id", F.explode(F.transform(F.sequence(F.lit(0), (F.octet_length("prefix") / 8).cast("int") - 1), lambda i: F.substring("prefix", i * 8 + 1, 8))).alias("shingle"))
    ties = common.group_min(posts, ["shingle"], "id", "least").where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    grouped = components(ties, name="jaccard-ties").withColumnsRenamed({"u": "id", "component": "group"})
    weighed = partners.select("id", "n_shingles", "shared").join(grouped, "id").withColumn("w", F.octet_length("shared") / 8)
    weighed = common.stage(weighed, "jaccard-groups")
    links = _links(weighed, percent)
    linked = components(links, name="jaccard-links").withColumnsRenamed({"u": "id", "component": "component_id"})
    copies = common.stage(partners.select("id", "copies"), "jaccard-copies")
    common.discard(partners, weighed)

    # members of one text share its id, and a text may be a third of all rows: those of many copies join by salted ids
    hot = F.col("copies") > MANY_COPIES
    salts = F.sequence(F.lit(0), F.when(hot, F.lit(common.SALTS - 1)).otherwise(F.lit(0)))
    spread = linked.join(copies, "id").select("id", "component_id", F.explode(salts).alias("salt"))
    salt = F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(common.SALTS)).cast("int")).otherwise(F.lit(0))
    named_rows = members.withColumn("salt", salt).join(spread, ["id", "salt"], "left")
    out = named_rows.select("doc_id", "n_shingles", F.coalesce("component_id", "id", "doc_id").alias("component_id"))
    alone = common.stage(found.where("signature is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")), "jaccard-alone")
    common.discard(found)
    return out.unionByName(alone)


def _links(weighed: DataFrame, percent: int) -> DataFrame:
    """Links of all groups: small ones in a task each, larger ones by ``_hubs`` and
    then as pairs of blocks."""
    alone = weighed.withColumn("part", F.col("id"))
    large = weighed.groupBy("group").agg(F.sum("w").alias("volume")).where(F.col("volume") > GROUP_SHINGLES).select("group")
    large = common.stage(large, "jaccard-large")
    if not large.limit(1).count():
        return _search(alone, ["group"], percent)
    parted, hub_links = _hubs(common.stage(weighed.join(large, "group"), "jaccard-big"), percent)
    # rows that lie by group would stay so, all pairs of a group in one task, unless dealt out anew
    pair = ["group", "a", "b"]
    pairs = _search(_blocked(parted).repartition(*pair), pair, percent)
    return _search(alone.join(large, "group", "left_anti"), ["group"], percent).unionByName(pairs).unionByName(hub_links)


def _hubs(big: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Large groups with part, a component so far, and the links found.

    In each round a few texts that aren't linked yet become hubs, and all such texts
    are held against the hubs of their group. What is left is for the search by blocks.
    """
    left, links = big, None
    for r in range(HUB_ROUNDS):
        order = Window.partitionBy("group").orderBy(F.xxhash64("id", F.lit(r)), "id")
        path = common.shared_dir(big.sparkSession, "jaccard-hubs")
        left.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= HUBS).select("group", "id", "n_shingles", "shared").write.parquet(path)
        found = common.stage(_against(left, path, percent), "jaccard-hub-links")
        links = found if links is None else links.unionByName(found)
        before, left = left, common.stage(left.join(found.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_anti"), "jaccard-left")
        if before is not big:
            common.discard(before)
    tied = components(links, name="jaccard-hub-ties").withColumnsRenamed({"u": "id", "component": "part"})
    return big.join(tied, "id", "left").withColumn("part", F.coalesce("part", "id")), links


def _against(texts: DataFrame, path: str, percent: int) -> DataFrame:
    """Links of texts with the hubs of their groups, which lie in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.open_fs(path)
        hubs = dataset.dataset([i.path for i in fs.get_file_info(FileSelector(root)) if i.path.endswith(".parquet")], filesystem=fs, format="parquet")
        known: dict[int, list] = {}
        for batch in batches:
            groups = batch.column(0).to_pylist()
            if new := set(groups) - known.keys():
                if len(known) > 256:
                    known.clear()
                    new = set(groups)
                known.update({g: [] for g in new})
                for h in hubs.to_table(filter=dataset.field("group").isin(sorted(new))).to_pylist():
                    known[h["group"]].append((h["id"], h["n_shingles"], np.frombuffer(h["shared"], "<u8")))
            out = []
            for group, key, size, shared in zip(groups, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(shared.as_py(), "<u8")
                for hub, n, other in known[group]:
                    least = need(size, n, percent)
                    if hub != key and least <= min(size, n) and len(np.intersect1d(own, other, assume_unique=True)) >= least:
                        out.append((hub, key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

    return texts.select("group", "id", "n_shingles", "shared").mapInArrow(run, "u long, v long")


def _blocked(parted: DataFrame) -> DataFrame:
    """Rows of large groups, dealt to pairs of blocks.

    The largest part of a group makes the first blocks, the other texts the last
    ones. A text goes to every pair of its own block and another, but for pairs
    of first blocks, whose texts are joined already. The number of blocks follows
    the group's own volume, so the memory of a task stays bounded.
    """
    volumes = parted.groupBy("group", "part").agg(F.sum("w").alias("volume"))
    volumes = volumes.groupBy("group").agg(F.max(F.struct("volume", "part")).alias("main"), F.sum("volume").alias("volume"))
    count = lambda v: F.ceil(2 * v / GROUP_SHINGLES).cast("int")
    volumes = volumes.select("group", F.col("main.part").alias("main"), count(F.col("main.volume")).alias("first"), count(F.col("volume") - F.col("main.volume")).alias("last"))
    salt = F.xxhash64("id")
    block = F.when(F.col("part") == F.col("main"), F.pmod(salt, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(salt, F.greatest("last", F.lit(1)))).cast("int")
    dealt = parted.join(volumes, "group").withColumn("block", block)
    every = F.sequence(F.lit(0), F.col("first") + F.col("last") - 1)
    others = F.filter(every, lambda k: (k != F.col("block")) & (F.greatest(k, F.col("block")) >= F.col("first")))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    return dealt.select("group", "id", "n_shingles", "shared", "part", F.explode(pairs).alias("p")).select("group", "id", "n_shingles", "shared", "part", "p.a", "p.b")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the smallest doc_id stays.

    Of rows that repeat in all columns one stays. Other rows of one doc_id count
    by their own text: each goes only if a near copy of it has a smaller doc_id.
    Rows without doc_id stay, as do all columns of the input, whatever their names.
    Null and empty texts have no copies; an empty table gives no rows.
    """
    if not docs.schema:
        return docs
    gone_id, same, copy = common.fresh(docs.columns, "gone", "same", "copy")
    hashed = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"))
    repeats = hashed.groupBy("d").agg(F.count(F.lit(1)).alias("n"), (F.min("h") != F.max("h")).alias("mixed"))
    repeats = repeats.agg(F.max("n").alias("n"), F.max("mixed").alias("mixed")).first()
    if repeats["mixed"]:
        left = _left_by_row(docs, words, percent, doc_id, text)
    else:
        gone = classes(docs, words, percent, doc_id, text).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
        left = docs.join(gone, docs[doc_id] == gone[gone_id], "left_anti")
    if (repeats["n"] or 0) < 2:
        return left  # no row repeats, so whole rows needn't be compared
    # a digest of the whole row; maps have no order, so they are compared as sorted entries
    parts = [F.struct(F.array_sort(F.map_entries(F.col(f"`{f.name}`")))) if isinstance(f.dataType, MapType) else F.struct(F.col(f"`{f.name}`")) for f in docs.schema]
    whole = F.sha2(F.concat_ws("\x1f", *[F.to_json(p, {"ignoreNullFields": "false"}) for p in parts]), 256)
    order = Window.partitionBy(doc_id, same).orderBy(same)
    left = left.withColumn(same, whole).withColumn(copy, F.row_number().over(order))
    return left.where(F.col(doc_id).isNull() | (F.col(copy) == 1)).drop(same, copy)


def _left_by_row(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """What stays of ``docs`` where texts differ within a doc_id: components are
    found over numbered rows, as one doc_id may stand in several."""
    (row,) = common.fresh(docs.columns, "row")
    rows = common.stage(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    named = rows.where(F.col(doc_id).isNotNull())
    found = classes(named, words, percent, row, text).select(F.col("doc_id").alias("row"), "component_id")
    found = found.join(named.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id")), "row")
    least = common.group_min(found, ["component_id"], "doc_id", "least", "copies")
    gone = common.stage(least.where("doc_id <> least").select(F.col("row").alias(row)), "jaccard-gone")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
