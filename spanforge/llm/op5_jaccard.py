"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles; two documents link when
100 * |A and B| >= 80 * |A or B|. The result is one row per document with the
smallest doc_id of its component of links.

Method. Tokens (64-bit shingle hashes) are XOR-ed into a bit sketch, so bit i is the
parity of the tokens that fall on it. Two sketches differ in at most |A xor B| bits,
and linked sets of sizes a <= b have |A xor B| <= (a + b) / 9. Sizes are cut into
bands whose upper ends grow by 1.25, so linked sets lie in the same band or in
neighbouring ones; a band's sketch has k segments, more than the largest such
difference d, and a differing token changes one segment, so at least k - d segments
agree. Segments are joined on (band, segment, digest of its bits).

Tokens of very many documents (a licence line, a shared passage) are left out of these
sketches, which leaves d as a bound and keeps unlike documents apart; which tokens
those are is estimated on a hash sample of documents and held in a bitmap of fixed
size, and any choice gives the same result. Blank segments say nothing and are left
out by sets that have fewer than k - d of them: two linked sets agree on at least
that many segments, so a full one agrees. The other sets (``k`` holds spare segments
against this) also emit segments of all their tokens, in a family of keys of their
own, and the blank ones if they still have as many.

Candidates are verified exactly on the shingle hashes, in rounds that avoid
forming all pairs of a group of copies: equal sets collapse first; each set is then
verified against the hub it shares most segments with (the hub of a segment is its
member that shares most segments with others: the text that copies were made from,
if it is there); then against its other hubs where their components still differ;
and last, segments whose members still lie in several components are searched in
blocks of bounded size. Sketches leave the members that have a near one in another
component, each with the head of its cluster of near ones in the block; clusters are
joined over all blocks. What links lies in one cluster, so each cluster is a block of
a second search, by shingles, with every set once; of clusters too large for a block,
the blocks of the first search are searched again. The second search links exactly and
keeps the components of its block, so that it skips pairs of one component and gives a
spanning forest: a block gives fewer rows than it has members, and no table of pairs
is ever written. Pairs within a component need no check, as they cannot change it.
Before verification, pairs are bounded by their sizes and the Hamming distance of
sketches as long as the sets; shingles are fetched only for what passes this.

A set's id has 64 bits and is checked by 64 others: ids that two sets share (about
n^2 / 2^65 of n sets, so a few hundred of 10^11) are found and replaced by the check.

Edge cases: null, empty and wordless texts have an empty set and stay alone; texts of
fewer words than a shingle are one shingle; equal rows link; a null doc_id takes the
component of its copies, or null; an empty table gives no rows; long texts are hashed
in pieces of ``PIECE`` bytes, and blocks are bounded by shingles as well as members.
Columns besides the id and the text, and ``key``, which is passed on, are not read. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import connected_labels, discard, materialize, slices, table, texts_of

WIDTH = 5
#: Bytes of text that are hashed together, unless one text is longer.
BATCH_BYTES = 1 << 20
#: Bytes hashed by one running sum.
PIECE = 1 << 20
#: Members and shingles of one side of a block, and 64-bit words compared at once.
BLOCK, BLOCK_SHINGLES, PAIR_WORDS = 4096, 1 << 21, 1 << 19
SLOT_BITS = 24
SEEN_SETS = 1 << 16
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_UPPER_LOWER = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct 64-bit shingle hashes of texts, sorted.

    A word's hash is a polynomial over random values of its bytes, taken for all
    words of a batch from one running sum, then mixed.
    """

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * _M3)
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.up, self.down = _powers(1 << 16, self.BASE), _powers(1 << 16, self.INVERSE)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word of the bytes, which begin and end blank."""
        a = np.frombuffer(data, np.uint8)
        if len(self.up) < min(len(a), PIECE):
            self.up, self.down = _powers(PIECE, self.BASE), _powers(PIECE, self.INVERSE)
        at, sums, downs, carry = [], [], [], np.uint64(0)
        for low in range(0, len(a), PIECE):
            piece = a[low : low + PIECE]
            run = np.cumsum(self.values[piece] * self.up[: len(piece)]) * np.uint64(pow(self.BASE, low, 1 << 64)) + carry
            edge = np.flatnonzero(np.diff(self.blank[a[low : low + PIECE + 1]]))
            at.append(edge + low)
            sums.append(run[edge])
            downs.append(self.down[edge] * np.uint64(pow(self.INVERSE, low, 1 << 64)))
            carry = run[-1]
        edge, run, down = np.concatenate(at), np.concatenate(sums), np.concatenate(downs)
        # edges in turn: the blank before a word, the word's last byte
        return mix((run[1::2] - run[0::2]) * down[0::2]), edge[0::2] + 1

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) > 1 and sum(map(len, texts)) > BATCH_BYTES:
            half = len(texts) // 2
            return self.sets(texts[:half]) + self.sets(texts[half:])
        data = b" ".join([b"", *texts, b""]).translate(_UPPER_LOWER)
        ends = np.cumsum([1 + len(t) for t in texts])
        h, at = self.words(data)
        counts = np.diff(np.searchsorted(at, ends), prepend=0)
        g = np.full(max(len(h) - self.width + 1, 0), self.width, np.uint64)
        for i in range(self.width):
            g = mix(g * _M3 + h[i : i + len(g)])
        out, low = [], 0
        for n in counts.tolist():
            if n >= self.width:
                s = np.sort(g[low : low + n - self.width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n:
                whole = np.full(1, n, np.uint64)
                for i in range(n):
                    whole = mix(whole * _M3 + h[low + i])
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
            low += n
        return out


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Signed 64-bit id and check of a set; neither depends on order."""
    m, n = mix(s + _M3), np.uint64(len(s))
    both = mix(np.array([np.bitwise_xor.reduce(m) + n, m.sum(dtype=np.uint64) ^ (n * _M1)], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


class SetIds:
    """Ids of sets: ``bits`` of their first hash, or the second where two sets share those."""

    def __init__(self, bits: int = 64, shared: frozenset[int] = frozenset()) -> None:
        self.bits, self.shared = bits, shared

    def both(self, s: np.ndarray) -> tuple[int, int]:
        i, check = set_hashes(s)
        return (i if self.bits == 64 else i & ((1 << self.bits) - 1)), check

    def __call__(self, s: np.ndarray) -> int:
        i, check = self.both(s)
        return check if i in self.shared else i


def band_top(band: int) -> int:
    """Largest size of a band; the next band's sizes reach a quarter above it, at least."""
    top = 1
    for _ in range(band):
        top = max(top + 1, top * 5 // 4)
    return top


_TOPS = [band_top(b) for b in range(140)]


def band_of(size: int) -> int:
    return int(np.searchsorted(_TOPS, size))


def segments_of(band: int) -> tuple[int, int]:
    """(k, k - d): segments of a band's sketches, and how many agree at least.

    Sets joined in a band have sizes up to its top, and the other up to 5/4 of that.
    """
    top = _TOPS[band]
    d = (top + top * 5 // 4) // 9
    k = d + 2 + (d + 16) // 24
    return k, k - d


def _digests(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of a sketch that are not blank, and a digest of the bits of each.

    A segment has 2^20 bits, held sparsely: its digest is the XOR of one random word
    per set bit, so tokens that fall on one bit cancel out, as parities do.
    """
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    segment = ((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)  # rises with s
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    at, digest = segment[starts], np.bitwise_xor.reduceat(mix((s & np.uint64(0xFFFFF)) * _M3 + np.uint64(1)), starts)
    full = digest != 0
    return (at, digest) if full.all() else (at[full], digest[full])


def segment_keys(s: np.ndarray, rare: np.ndarray, band: int) -> list[np.ndarray]:
    """Join keys of one set in one band: hashes of (family, band, segment, digest)."""
    k, agree = segments_of(band)

    def hashed(family: int, at: np.ndarray, digest: np.ndarray) -> np.ndarray:
        return mix(digest + mix(at.astype(np.uint64) * _M3 + np.uint64(2 * band + family + 1)))

    at, digest = _digests(rare, k)
    out = [hashed(0, at, digest)]
    if k - len(at) >= agree:
        at, digest = _digests(s, k) if len(rare) < len(s) else (at, digest)
        if k - len(at) >= agree:
            every = np.zeros(k, np.uint64)
            every[at] = digest
            at, digest = np.arange(k), every
        out.append(hashed(1, at, digest))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """64-bit words of a bit sketch as long as the set; bit i is the parity of its tokens.

    The length is a power of two, so that a longer sketch folds to a shorter one.
    """
    m = max(128, 1 << (len(s) - 1).bit_length()) if len(s) else 128
    bits = np.bincount(((s >> np.uint64(10)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _meta(width, ids):
    """Sets of (doc_id, text, key)."""

    def run(batches):
        shingler = Shingler(width)
        for b in slices(batches):
            sets = shingler.sets(texts_of(b))
            both = [ids.both(s) if len(s) else (None, None) for s in sets]
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_id", "check", "sketch", "key"])

    return run


def _sample(width):
    def run(batches):
        shingler = Shingler(width)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *shingler.sets(texts_of(b))]).view(np.int64))], ["id"])

    return run


def frequent_tokens(texts: DataFrame, width: int = WIDTH, often: int = 200, rate: float = 0.02, least_docs: int = 2000) -> bytes:
    """Bitmap of tokens that about ``often`` documents or more hold, by a sample.

    The sample is a share of the documents, so it grows with them; where too many
    tokens qualify for the bitmap, only the commoner ones enter it.
    """
    rate = min(1.0, max(rate, least_docs / max(texts.count(), 1)))
    picked = texts.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30)))
    counts = materialize(picked.mapInArrow(_sample(width), "id long").groupBy("id").count().where(F.col("count") >= max(4, round(often * rate))))
    cut, room = 0, 1 << (SLOT_BITS - 3)
    if counts.count() > room:
        cut = counts.approxQuantile("count", [1 - room / counts.count()], 0.01)[0]
    bits = _bitmap(counts.where(F.col("count") > cut).select("id"))
    discard(counts)
    return bits


def in_bitmap(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = s & np.uint64((1 << SLOT_BITS) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _keys(width, frequent, identify):
    """(key, set_id); a set met again by the same task, if remembered, is not repeated."""

    def run(batches):
        shingler, seen = Shingler(width), set()
        common = np.frombuffer(frequent.value, np.uint64)
        for b in slices(batches):
            keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in shingler.sets(texts_of(b)):
                if not len(s) or (i := identify(s)) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(i)
                own, rare = band_of(len(s)), s[~in_bitmap(s, common)]
                for band in (own, own - 1) if own else (own,):
                    for k in segment_keys(s, rare, band):
                        keys.append(k)
                        ids.append(np.full(len(k), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "set_id"])

    return run


def _runs(batches):
    """Reads (key, set_id) sorted; gives (key, leader, member) for keys of several sets.

    Streams: what it holds is one batch and the last key.
    """
    last_key = last_lead = last_id = None
    for b in batches:
        key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        first = np.empty(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        first[0] = last_key is None or key[0] != last_key
        again = np.zeros(len(key), bool)
        again[1:] = ~first[1:] & (ids[1:] == ids[:-1])
        again[0] = not first[0] and ids[0] == last_id
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        lead = np.where(at >= 0, ids[np.maximum(at, 0)], last_lead if last_lead is not None else 0)
        out = ~first & ~again & (lead != ids)
        last_key, last_lead, last_id = key[-1], lead[-1], ids[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(lead[out]), pa.array(ids[out])], ["key", "leader", "member"])


def _bitmap(ids: DataFrame) -> bytes:
    """Fixed-size bitmap over set ids (2^24 bits); built as at most 2^18 words of 64."""
    slots = ids.select(F.pmod(F.col("id"), F.lit(1 << SLOT_BITS)).alias("slot"))
    words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    for w in words.toLocalIterator():
        out[w["word"]] = w["bits"]
    return out.tobytes()


def _sets(width, bits, identify):
    """(set_id, shingles) of the sets that the bitmap names."""

    def run(batches):
        wanted = np.frombuffer(bits.value, np.int64)
        shingler, seen = Shingler(width), set()
        for b in slices(batches, 64):
            rows = []
            for s in shingler.sets(texts_of(b)):
                if not len(s):
                    continue
                i = identify(s)
                slot = i % (1 << SLOT_BITS)
                if i in seen or not (int(wanted[slot >> 6]) >> (slot & 63)) & 1:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(i)
                rows.append((i, s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["set_id", "shingles"])

    return run


def near(pairs: DataFrame, light: DataFrame, percent: int = 80) -> DataFrame:
    """Those of the pairs (a, b) of set ids that sizes and sketches allow to link."""
    x = light.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    y = light.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    fits = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    folded = "case when size({0}) > size({1}) then zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y) else {0} end"
    apart = F.expr(f"aggregate(zip_with({folded.format('ka', 'kb')}, {folded.format('kb', 'ka')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return fits.where(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).drop("na", "nb", "ka", "kb")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """Those of the pairs (a, b) of set ids that link."""
    full = pairs.select("a", "b").join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return full.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").select("*", F.coalesce("la", "a").alias("ca"), F.coalesce("lb", "b").alias("cb"))


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after further edges (a, b); deletes ``labels``.

    Only the edges between different components are followed.
    """
    ends = connected_labels(_labelled(edges, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    top = ends.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = materialize(old.unionByName(ends.join(labels.select("node"), "node", "left_anti")))
    discard(ends)
    discard(labels)
    return out


def _memberships(runs: DataFrame) -> DataFrame:
    """(key, id) of the segments that several sets share."""
    return runs.select("key", F.col("member").alias("id")).union(runs.select("key", F.col("leader").alias("id")).distinct())


def _hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b, n): sets b with the hubs a of n of their segments."""
    degree = members.groupBy("id").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("top")).select("key", F.col("top.id").alias("hub"))
    return members.join(hubs, "key").where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("n"))


def _folded(sketches: pa.ListArray) -> np.ndarray:
    """Sketches as rows, each folded to the shortest length among them."""
    words = sketches.flatten().to_numpy().view(np.uint64)
    sizes = np.diff(sketches.offsets.to_numpy())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sizes), sizes.min()), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = words[starts[at][:, None] + np.arange(size)]
        out[at] = np.bitwise_xor.reduce(rows.reshape(len(at), -1, out.shape[1]), 1)
    return out


def _near_in_group(group: pa.Table, percent: int) -> np.ndarray:
    """The first member of each member's cluster.

    Members of different components that sizes and sketches let link are in one cluster.
    """
    col = {c: group.column(c).to_numpy() for c in ("label", "n", "side")}
    m = _folded(group.column("sketch").combine_chunks())
    split, k = len(np.unique(col["side"])) > 1, len(m)
    step, head = max(1, PAIR_WORDS // m.size), np.arange(k)
    for i in range(0, k, step):
        apart = np.bitwise_count(m[i : i + step, None, :] ^ m[None, i:, :]).sum(2, dtype=np.int64)
        n, o = col["n"][i : i + step, None], col["n"][None, i:]
        fits = (apart * (100 + percent) <= (n + o) * (100 - percent)) & (100 * np.minimum(n, o) >= percent * np.maximum(n, o))
        fits &= col["label"][i : i + step, None] != col["label"][None, i:]
        if split:
            fits &= col["side"][i : i + step, None] != col["side"][None, i:]
        x, y = np.nonzero(fits)
        while len(x):
            hx, hy = head[x + i], head[y + i]
            differ = hx != hy
            if not differ.any():
                break
            np.minimum.at(head, np.maximum(hx, hy)[differ], np.minimum(hx, hy)[differ])
            while (head[head] != head).any():
                head = head[head]
    return head


def forest(ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of the sets as all links between them would.

    Fewer than there are sets. Sets of one side are not compared if there are two.
    """
    sizes, k = np.array([len(s) for s in sets]), len(sets)
    starts = np.cumsum(sizes) - sizes
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, comp, out = np.zeros(int(token.max()) + 1, bool), np.unique(labels, return_inverse=True)[1], []
    m = np.uint64(max(128, 1 << (4 * int(sizes.max()) - 1).bit_length()))
    rough = np.stack([np.packbits((np.bincount(((s >> np.uint64(10)) & (m - np.uint64(1))).astype(np.int64), minlength=int(m)) & 1).astype(np.uint8)).view(np.uint64) for s in sets])
    split = len(np.unique(sides)) > 1
    for i in range(k - 1):
        fits = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(sizes[i], sizes[i + 1 :]) >= percent * np.maximum(sizes[i], sizes[i + 1 :]))
        if split:
            fits &= sides[i + 1 :] != sides[i]
        others = np.flatnonzero(fits) + i + 1
        if not len(others):
            continue
        apart = np.bitwise_count(rough[others] ^ rough[i]).sum(1, dtype=np.int64)
        others = others[apart * (100 + percent) <= (sizes[i] + sizes[others]) * (100 - percent)]
        own = token[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        step = max(1, PAIR_WORDS // int(sizes.max()))
        for low in range(0, len(others), step):
            part = others[low : low + step]
            n = sizes[part]
            first = np.cumsum(n) - n
            both = np.add.reduceat(mark[token[np.repeat(starts[part] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
            for j in part[100 * both >= percent * (sizes[i] + n - both)]:
                if comp[j] != comp[i]:
                    out.append((int(ids[i]), int(ids[j])))
                    comp[comp == comp[j]] = comp[i]
        mark[own] = False
    return out


def _by_block(judge):
    """Reads rows sorted by their first column, block; gives ``judge`` of the rows of each block."""

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            t, key = pa.table(batch), batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != key[low]:
                    yield from judge(pa.concat_tables(held))
                    held.clear()
                held.append(t.slice(low, high - low))
        if held:
            yield from judge(pa.concat_tables(held))

    return run


def _near_members(percent):
    """(block, side, id, label, head) of the members that have a near one across components."""

    def judge(group):
        if len(group) > 1:
            head = _near_in_group(group, percent)
            near = np.bincount(head, minlength=len(head))[head] > 1
            out = group.select(["block", "side", "id", "label"]).append_column("head", pa.array(group.column("id").to_numpy()[head]))
            yield from out.filter(pa.array(near)).to_batches()

    return _by_block(judge)


def _forest(percent):
    """(a, b): the links of each block's spanning forest."""

    def judge(group):
        if len(group) > 1:
            held = group.column("shingles").combine_chunks()
            flat, cuts = held.flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(held.offsets.to_numpy()))[:-1]
            links = forest(*(group.column(c).to_numpy() for c in ("id", "label", "side")), np.split(flat, cuts), percent)
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], ["a", "b"])

    return _by_block(judge)


def _open_members(members: DataFrame, labels: DataFrame, light: DataFrame, percent: int = 80) -> DataFrame:
    """(block, side, id, label, head) of the members of open segments with a near one elsewhere.

    A segment whose members lie in several components is open. Its members are dealt
    to sides of at most ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles; every pair
    of sides is a block.
    """
    of = labels.select(F.col("node").alias("id"), "label")
    tagged = members.join(of, "id", "left").join(light.select(F.col("set_id").alias("id"), "n"), "id").select("key", "id", F.coalesce("label", "id").alias("label"), "n")
    mixed = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("n").alias("tokens")).where("low <> high")
    parts = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.least("size", F.ceil(F.col("tokens") / F.lit(BLOCK_SHINGLES)))).cast("int")
    open_ = tagged.join(mixed.select("key", parts.alias("parts")), "key").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sent = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = sent.join(light.select(F.col("set_id").alias("id"), "sketch"), "id").select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("block"), "side", "id", "label", "n", "sketch")
    return _blocked(rows).mapInArrow(_near_members(percent), "block long, side int, id long, label long, head long")


def _second_blocks(near: DataFrame, light: DataFrame) -> DataFrame:
    """(block, side, id, label): each cluster of near members, or the blocks of those too large."""
    clusters = connected_labels(near.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    sets = near.select("id", "label").distinct().join(clusters.select(F.col("node").alias("id"), F.col("label").alias("cluster")), "id")
    sets = materialize(sets.join(light.select(F.col("set_id").alias("id"), "n"), "id"))
    large = sets.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where((F.col("size") > BLOCK) | (F.col("tokens") > BLOCK_SHINGLES)).select("cluster")
    small = sets.join(large, "cluster", "left_anti").select(F.col("cluster").alias("block"), F.lit(0).alias("side"), "id", "label")
    again = near.join(sets.join(large, "cluster", "left_semi").select("id"), "id", "left_semi").select("block", "side", "id", "label")
    out = materialize(small.unionByName(again))
    discard(sets)
    discard(clusters)
    return out


def _blocked(rows: DataFrame) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "block").sortWithinPartitions("block")


def set_components(texts: DataFrame, light: DataFrame, width: int = WIDTH, identify: SetIds | None = None) -> DataFrame:
    """(node, label) of the set ids that link with another set.

    ``light`` has set_id, n and sketch of every distinct set.
    """
    spark, identify = texts.sparkSession, identify or SetIds()

    def fetched(ids: DataFrame) -> DataFrame:
        bits = spark.sparkContext.broadcast(_bitmap(ids))
        out = materialize(texts.mapInArrow(_sets(width, bits, identify), "set_id long, shingles array<long>").dropDuplicates(["set_id"]))
        bits.destroy()
        return out

    frequent = spark.sparkContext.broadcast(frequent_tokens(texts, width))
    keys = texts.mapInArrow(_keys(width, frequent, identify), "key long, set_id long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    runs = materialize(keys.repartition(n, "key").sortWithinPartitions("key", "set_id").mapInArrow(_runs, "key long, leader long, member long"))
    frequent.destroy()
    members = materialize(_memberships(runs))
    discard(runs)
    votes = materialize(near(_hub_pairs(members), light))
    sets = fetched(votes.select(F.col("a").alias("id")).union(votes.select(F.col("b").alias("id"))))
    best = votes.groupBy("b").agg(F.max(F.struct("n", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    links = materialize(verified(best, sets))
    labels = connected_labels(links)
    rest = _labelled(votes.join(best, ["a", "b"], "left_anti").select("a", "b"), labels).where("ca <> cb").select("a", "b")
    more = materialize(verified(rest, sets))
    labels = _merged(labels, more)
    discard(sets)
    last = materialize(_open_members(members, labels, light))
    parts = [links, more]
    if last.limit(1).count():
        second = _second_blocks(last, light)
        sets = fetched(second.select("id"))
        rows = second.join(sets.withColumnRenamed("set_id", "id"), "id").select("block", "side", "id", "label", "shingles")
        parts.append(materialize(_blocked(rows).mapInArrow(_forest(80), "a long, b long")))
        discard(sets)
        discard(second)
        labels = _merged(labels, parts[-1])
    for done in (members, votes, last, *parts):
        discard(done)
    return labels


def components(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64, key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, label (of the component, null for empty sets), key; one row per input row."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if key is None else key).cast("binary").alias("key"))
    texts = picked.select("text")
    meta = materialize(picked.mapInArrow(_meta(width, SetIds(id_bits)), "doc_id long, n_shingles long, set_id long, check long, sketch array<long>, key binary"))

    def distinct_sets() -> DataFrame:
        by = meta.where("set_id is not null").groupBy("set_id")
        return materialize(by.agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high")))

    light = distinct_sets()
    shared = [r["set_id"] for r in light.where("low <> high").select("set_id").collect()]  # see above: a few, of any corpus
    if shared:
        discard(light)
        meta = meta.withColumn("set_id", F.when(F.col("set_id").isin(shared), F.col("check")).otherwise(F.col("set_id")))
        light = distinct_sets()
    labels = set_components(texts, light, width, SetIds(id_bits, frozenset(shared)))
    discard(light)
    # per distinct set first, so that a large group of copies is one row
    lows = meta.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    tagged = lows.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").select("set_id", "low", F.coalesce("label", "set_id").alias("label"))
    ends = tagged.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = tagged.join(ends, "label").select("set_id", "component_id", "label")
    return meta.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label", "key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
