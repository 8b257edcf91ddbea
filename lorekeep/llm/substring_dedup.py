"""Near-duplicate passages across documents by compact windows.

A text is a sequence of five-word shingles. Under one hash function, the Cartesian tree over the shingles' hashes groups
all of the text's subsequences by the place of their minimum: the node at place c stands for every subsequence that lies
in its subtree's interval [l, r] and holds c, all of which have c's hash as signature. Only nodes whose interval has at
least the length of a passage matter. They are few (about 2 n / t of n places), and are found without the rest of the
tree: as a frame of t shingles moves to the right, so does the minimum's place, and each run of one place is such a node.
Its window is the union of these frames: the node's interval as far as it lies within t - 1 places of c. What lies
further away is in the windows of other nodes.

Windows of equal signature are sorted together, and each is linked with the first of them and with the one before it, so
that links grow with the windows and not with the square of a group. Where a batch of documents has many windows of one
signature, this is done within the batch, and only the windows of its first document go on: a passage that a third of all
documents has costs a row for each batch, not one for each document. Frames of t shingles in windows whose signature
repeats are linked with the first equal frame too, so that equal passages are linked whatever stands between them; those
of signatures that a sample shows to be frequent are dealt out by the frame itself. Passages that are alike but not equal
have a run of ``RUN`` shingles in common; ``near_links`` links all documents that share such a run, however many. Links
of two documents along one diagonal join into an interval pair, kept if enough hash functions agree. Pairs are then
verified on the shingles themselves: texts of the documents concerned are cut into cells of shingles, each cell is sent to
the pairs that need it, and the places of the one interval whose shingles the other has make up passages, which need a
length of ``t`` and a similarity of 0.8. What a task holds for a pair is bounded by its two texts.

The result has a row for each passage that repeats one of an earlier document (by id): ``doc_id``, ``start`` and ``stop``
(words, stop excluded), ``n_words``, the same of the source, and ``similarity``. ``variant`` and ``source_variant`` are 0,
or the 64-bit hash of the text where its id has several texts.

Defined results: null, empty and short texts have no passages; a text of any length counts whole; rows that repeat an id
and a text are one document; rows that repeat an id with different texts are as many documents, in order of the texts'
hashes; rows without an id are left out; repeats within a document are not reported; an empty table gives an empty table;
only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh, in_batches, split_join
from .textvec import Words, batched, mix, shingles

SHINGLE = 5
PASSAGE_WORDS = 50
FUNCTIONS = 5
ENOUGH = 2
SIMILARITY = 0.8
CELL = 64
SLACK = 8
BREAK_SHARE = 0.25  # of a passage: so many words put in leave a similarity of 0.8
SHIFT = 64
LOCAL_GROUP = 64  # windows of one signature in one batch; more are linked there
EDGE = 2 * SLACK  # shingles beyond those around an anchor, for what words put in or left out move
CLASS_ROWS, CLASS_PLACES = 1000, 1 << 18  # anchors, and places of their texts, that are looked at together
PACK = 256  # anchors of a signature that lie in one row where they are held against others
RUN, ANCHOR = 20, 12  # shingles in a row that similar passages share at least; of these, so many tell where to compare
FEW = 16  # anchors of one signature that are linked in pairs without looking at what is around them
HOT_SAMPLE, HOT_COUNT, HOT_LIST = 10_000, 20, 20_000  # documents looked at, how many of them make a signature frequent, how many such at most


def text_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingle hashes, and where each text's begin (one more at the end)."""
    w = Words(texts)
    g = shingles(w.hashes(), SHINGLE)
    n = np.diff(w.first)
    if not len(g):
        return g, np.zeros(len(texts) + 1, dtype=np.int64)
    inside = w.doc[: len(g)] == w.doc[SHINGLE - 1 :]
    return g[inside], np.r_[0, np.cumsum(np.maximum(0, n - SHINGLE + 1))]


def compact_windows(g: np.ndarray, starts: np.ndarray, t: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, l, c, r, signature) of the nodes at least t wide, places counted from the text's first shingle.

    The lowest bits of a place's value are the place itself: equal hashes keep their order, and a minimum tells its place.
    """
    n = np.diff(starts)
    usable = np.flatnonzero(n >= t)
    if not len(usable):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),)
    bits = max(1, int(len(g) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    h = mix(g ^ mix(np.array([seed + 1], dtype=np.uint64))[0])
    v = (h & ~low) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= t:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < t:
        v = np.minimum(v[: len(v) - (t - width)], v[t - width :])
    place = (v & low).astype(np.int64)  # of the minimum of the frame that begins here
    frame_text = np.repeat(usable, n[usable] - t + 1)
    offset = np.concatenate([[0], np.cumsum(n[usable] - t + 1)])
    frame = starts[frame_text] + np.arange(len(frame_text)) - np.repeat(offset[:-1], n[usable] - t + 1)
    place = place[frame]
    new = np.r_[True, (place[1:] != place[:-1]) | (frame_text[1:] != frame_text[:-1])]
    # equal minima with nothing smaller between are one node: a stretch that repeats one shingle has one window
    new[1:] &= (h[place[1:]] != h[place[:-1]]) | (frame_text[1:] != frame_text[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    text, c = frame_text[first], place[first]
    base = starts[text]
    return text, frame[first] - base, c - base, frame[last] + t - 1 - base, mix(h[c] ^ np.uint64(seed * 2 + 1))


#: A document is (doc_id, variant); a window's place is its minimum's and how far it reaches to both sides.
PLACE = "doc_id long, variant long, c long, lefts long, rights long"
WINDOW = f"sig long, f int, {PLACE}, src struct<{PLACE}>"


def place_arrays(places: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array(places[k], pa.int64()) for k in ("doc_id", "variant", "c", "lefts", "rights")]


def as_rows(sig: np.ndarray, f: np.ndarray, own: dict[str, np.ndarray], src: dict[str, np.ndarray] | None) -> pa.RecordBatch:
    """Rows of ``WINDOW``; ``src`` is null without one."""
    names = ["doc_id", "variant", "c", "lefts", "rights"]
    kind = pa.struct([(n, pa.int64()) for n in names])
    source = pa.nulls(len(sig), kind) if src is None else pa.StructArray.from_arrays(place_arrays(src), names)
    columns = [pa.array(sig, pa.int64()), pa.array(f, pa.int32()), *place_arrays(own), source]
    return pa.RecordBatch.from_arrays(columns, names=["sig", "f", *names, "src"])


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, variant, shingle hashes, where each text's begin) of a batch's texts, about a megabyte at a time."""
    ids, variant = batch.column("doc_id").to_numpy(), batch.column("variant").to_numpy()
    texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
    for part in batched(list(enumerate(texts))):
        at = [i for i, _ in part]
        yield ids[at], variant[at], *text_shingles([x for _, x in part])


def local_links(sig: np.ndarray, own: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that go on, rows that are linked, what each is linked with). In groups of ``least`` rows or more of one
    signature, rows of the first document go on, and the others are linked with the first row and the one before."""
    order = np.lexsort((own["c"], own["variant"], own["doc_id"], sig))
    first = np.r_[True, sig[order][1:] != sig[order][:-1]]
    number = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    head = order[start][number]
    same = (own["doc_id"][order] == own["doc_id"][head]) & (own["variant"][order] == own["variant"][head])
    goes_on = same | (np.bincount(number)[number] < least)
    late = np.flatnonzero(~goes_on)
    before = order[late - 1]  # a late row is never the first of its group
    row = order[late]
    other = ((own["doc_id"][row] != own["doc_id"][before]) | (own["variant"][row] != own["variant"][before])) & (before != head[late])
    return order[goes_on], np.concatenate([row, row[other]]), np.concatenate([head[late], before[other]])


def windows(docs: DataFrame, t: int, functions: int) -> DataFrame:
    """Rows of ``WINDOW``: one for each compact window (``f`` has the function's bit), and the links (with ``src``) that a
    batch makes by itself, under a signature that spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[np.ndarray, ...]] = []
            for ids, variant, g, starts in parts_of(b):
                for f in range(functions):
                    text, left, c, right, sig = compact_windows(g, starts, t, f)
                    got.append((sig.view(np.int64), np.full(len(sig), 1 << f), ids[text], variant[text], c, c - left, right - c))
            if not got:
                continue
            sig, f, *rest = map(np.concatenate, zip(*got))
            if not len(sig):
                continue
            own = dict(zip(("doc_id", "variant", "c", "lefts", "rights"), rest, strict=True))
            on, row, src = local_links(sig, own, LOCAL_GROUP)
            take = lambda at: {k: v[at] for k, v in own.items()}
            yield as_rows(sig[on], f[on], take(on), None)
            if len(row):
                spread = mix((own["doc_id"][row] + own["c"][row]).view(np.uint64)).view(np.int64)
                yield as_rows(spread, f[row], take(row), take(src))

    return in_batches(docs).mapInArrow(run, WINDOW)


def document(prefix: str = "") -> tuple[Column, Column]:
    return F.col(f"{prefix}doc_id"), F.col(f"{prefix}variant")


def apart(one: str = "", other: str = "src.") -> Column:
    """Whether two places are of different documents."""
    (a, x), (b, y) = document(one), document(other)
    return (a != b) | (x != y)


def links(found: DataFrame) -> DataFrame:
    """(f, doc_id, variant, c, lefts, rights, src): each window with the first of its signature, and with the one before;
    links that a batch has made pass."""
    own = F.struct("doc_id", "variant", "c", "lefts", "rights")
    order = Window.partitionBy("sig", F.col("src").isNull()).orderBy("doc_id", "variant", "c")
    one, two = F.first(own).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lag(own).over(order)
    grouped = found.select("f", "doc_id", "variant", "c", "lefts", "rights", "src", one.alias("one"), two.alias("two")).where("src IS NOT NULL OR two IS NOT NULL")
    ways = F.when(F.col("src").isNotNull(), F.array("src")).when(F.col("one") == F.col("two"), F.array("one")).otherwise(F.array("one", "two"))
    return grouped.select("f", "doc_id", "variant", "c", "lefts", "rights", F.explode(ways).alias("src")).where(apart())


def frame_hashes(g: np.ndarray, t: int) -> np.ndarray:
    """A hash of each t neighbouring shingles, in order."""
    h, width = g, 1
    while 2 * width <= t:
        h = mix(h[:-width] ^ mix(h[width:] + np.uint64(width)))
        width *= 2
    return h if width == t else mix(h[: len(h) - (t - width)] ^ mix(h[t - width :] + np.uint64(t)))


def hot_signatures(docs: DataFrame, n: int, t: int, rows: int = HOT_SAMPLE, least: int = HOT_COUNT) -> list[int]:
    """Signatures under the first function that ``least`` or more of about ``rows`` of the ``n`` documents have. The list
    only decides how ``equal_links`` deals out its rows, not what it finds, so that a sample does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, g, starts in parts_of(b):
                text, *_, sig = compact_windows(g, starts, t, 0)
                if len(sig):
                    once = np.unique(np.stack([text, sig.view(np.int64)]), axis=1)[1]
                    yield pa.RecordBatch.from_arrays([pa.array(once, pa.int64())], names=["sig"])

    some = docs.sample(False, min(1.0, rows / max(n, 1)), 7) if n > rows else docs
    counts = in_batches(some).mapInArrow(run, "sig long").groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r["sig"] for r in counts.orderBy(F.desc("n"), "sig").limit(HOT_LIST).collect()]


SOURCE = "src struct<doc_id: long, variant: long, c: long>"
FRAMES = f"sig long, doc_id long, variant long, c long, more long, frames binary, {SOURCE}"
NAMES = ["doc_id", "variant", "c"]


def frame_rows(key: str, keys: np.ndarray, own: list[np.ndarray], more: np.ndarray, frames: list[bytes] | None, src: list[np.ndarray] | None) -> pa.RecordBatch:
    kind = pa.struct([(n, pa.int64()) for n in NAMES])
    source = pa.nulls(len(keys), kind) if src is None else pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in src], NAMES)
    columns = [pa.array(x, pa.int64()) for x in (keys, *own, more)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(frames or [None] * len(keys), pa.binary()), source], names=[key, *NAMES, "more", "frames", "src"])


def joined_runs(own: list[np.ndarray], src: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Links of frames that follow each other in both documents, as one link each and how many more frames it has."""
    order = np.lexsort((own[2], own[2] - src[2], src[1], src[0], own[1], own[0]))
    own, src = [x[order] for x in own], [x[order] for x in src]
    key = [own[0], own[1], src[0], src[1], own[2] - src[2]]
    new = np.r_[True, np.any([x[1:] != x[:-1] for x in key], axis=0) | (own[2][1:] > own[2][:-1] + 1)]
    start = np.flatnonzero(new)
    last = np.r_[start[1:], len(new)] - 1
    return [x[start] for x in own], own[2][last] - own[2][start], [x[start] for x in src]


def link_rows(own: list[np.ndarray], src: list[np.ndarray], key: str) -> Iterator[pa.RecordBatch]:
    if len(own[0]):
        own, more, src = joined_runs(own, src)
        yield frame_rows(key, mix((own[0] + own[2]).view(np.uint64)).view(np.int64), own, more, None, src)


def equal_links(docs: DataFrame, t: int, functions: int, hot: list[int]) -> DataFrame:
    """Rows like those of ``links``: each frame of t shingles with the first equal one, so that what stands between two
    equal passages does not matter. Only windows whose signature under the first function occurs again can hold such
    frames. Equal frames agree under all functions, and frames that follow each other are one link.

    Windows of a signature follow each other in a task, and come to Python in batches. Equal frames in a batch are linked
    there; only a signature that the batch's ends may cut goes on, frame by frame. Frames of ``hot`` signatures stand for
    themselves from the start, each with its own hash as signature."""
    often = np.sort(np.array(hot, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            single: list[tuple[np.ndarray, ...]] = []
            for ids, variant, g, starts in parts_of(b):
                text, left, _, right, sig = compact_windows(g, starts, t, 0)
                if not len(text):
                    continue
                sig, h, begin = sig.view(np.int64), frame_hashes(g, t).view(np.int64), starts[text]
                n = right - left - t + 2
                near = np.isin(sig, often)
                few = np.flatnonzero(~near)
                own = [h[a : a + k].tobytes() for a, k in zip((begin + left)[few], n[few], strict=True)]
                yield frame_rows("sig", sig[few], [ids[text][few], variant[text][few], left[few]], np.zeros(len(few)), own, None)
                many = np.flatnonzero(near)
                if len(many):
                    k = n[many]
                    place = np.repeat(left[many], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    whose = np.repeat(text[many], k)
                    single.append((h[starts[whose] + place], ids[whose], variant[whose], place))
            if single:
                frame, *own = map(np.concatenate, zip(*single))
                key = mix(frame.view(np.uint64)).view(np.int64)
                on, row, src = local_links(key, dict(zip(NAMES, own, strict=True)), 2)
                yield frame_rows("sig", key[on], [x[on] for x in own], np.zeros(len(on)), [frame[i : i + 1].tobytes() for i in on], None)
                yield from link_rows([x[row] for x in own], [x[src] for x in own], "sig")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = b.column("src").is_valid().to_numpy(zero_copy_only=False)
            done = b.filter(pa.array(made))
            if len(done):
                yield pa.RecordBatch.from_arrays([done.column(x) for x in ("sig", *NAMES, "more", "frames", "src")], names=["frame", *NAMES, "more", "frames", "src"])
            rest = b.filter(pa.array(~made))
            if not len(rest):
                continue
            sig, ids, variant, left = (rest.column(x).to_numpy() for x in ("sig", *NAMES))
            raw = rest.column("frames").to_pylist()
            h = np.frombuffer(b"".join(raw), dtype=np.int64)
            n = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 8
            row = np.repeat(np.arange(len(raw)), n)
            own = [ids[row], variant[row], left[row] + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)]
            order = np.argsort(h, kind="stable")  # rows come in the order of documents
            first = np.r_[True, h[order][1:] != h[order][:-1]]
            head = order[np.flatnonzero(first)][np.cumsum(first) - 1]
            late = (own[0][order] != own[0][head]) | (own[1][order] != own[1][head])
            yield from link_rows([x[order[late]] for x in own], [x[head[late]] for x in own], "frame")
            edge = order[~late & ((sig == sig[0]) | (sig == sig[-1]))[row[order]]]
            if len(edge):
                yield frame_rows("frame", h[edge], [x[edge] for x in own], np.zeros(len(edge)), None, None)

    alone = Window.partitionBy("sig", F.col("src").isNull()).orderBy(*NAMES)
    found = in_batches(docs).mapInArrow(run, FRAMES)
    found = found.select("*", F.lag("doc_id").over(alone).alias("before"), F.lead("doc_id").over(alone).alias("after"))
    found = found.where("src IS NOT NULL OR before IS NOT NULL OR after IS NOT NULL").drop("before", "after")
    found = in_batches(found).mapInArrow(each, FRAMES.replace("sig long", "frame long"))
    star = Window.partitionBy("frame", F.col("src").isNull()).orderBy(*NAMES).rowsBetween(Window.unboundedPreceding, 0)
    found = found.select(*NAMES, "more", F.coalesce("src", F.first(F.struct(*NAMES)).over(star)).alias("src")).where(apart())
    reach = lambda: [F.lit(0).cast("long").alias("lefts"), (F.col("more") + (t - 1)).alias("rights")]
    src = F.struct(*(F.col(f"src.{n}").alias(n) for n in NAMES), *reach())
    return found.select(F.lit((1 << functions) - 1).alias("f"), *NAMES, *reach(), src.alias("src"))


ANCHORS = "sig long, around long, doc_id long, variant long, c long"
CLASSES = f"{ANCHORS}, wide binary"


def anchor_rows(g: np.ndarray, starts: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """(text, c, signature, hash of the t shingles on both sides and the anchor) of each text's anchors: runs of ``ANCHOR``
    shingles, one at least among any ``RUN`` shingles in a row, and the same one wherever these stand."""
    n = np.diff(starts)
    whose = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(g)) - starts[whose]
    use = np.flatnonzero((place <= n[whose] - ANCHOR) & (n[whose] >= t))
    if not len(use):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    runs = np.where(n >= t, n - ANCHOR + 1, 0)
    text, _, c, _, sig = compact_windows(frame_hashes(g, ANCHOR)[use], np.r_[0, np.cumsum(runs)], RUN - ANCHOR + 1, 0)
    padded = np.zeros(len(g) + 2 * t * len(n), dtype=np.uint64)
    padded[np.arange(len(g)) + t * (2 * whose + 1)] = g
    around = frame_hashes(padded, 2 * t + ANCHOR)[starts[text] + 2 * t * text + c]
    return text, c, sig.view(np.int64), around.view(np.int64)


def anchors(docs: DataFrame, t: int) -> DataFrame:
    """Rows of ``ANCHORS``; of a batch's anchors that are equal with all around them, the first document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, variant, g, starts in parts_of(b):
                text, c, sig, around = anchor_rows(g, starts, t)
                order = np.lexsort((c, variant[text], ids[text], around, sig))
                new = np.r_[True, (sig[order][1:] != sig[order][:-1]) | (around[order][1:] != around[order][:-1])][: len(order)]
                on = order[new]
                columns = [sig[on], around[on], ids[text][on], variant[text][on], c[on]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["sig", "around", *NAMES])

    return in_batches(docs).mapInArrow(run, ANCHORS)


def what_counts(win: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows count, what counts in each and 0 elsewhere). A row has an anchor's shingles and t on both sides, 0 where no
    other document has the shingle. Of a frame of t shingles with the anchor in it, a similar passage has all but
    ``t // 4``; what lies outside such frames is of no account."""
    gone = np.concatenate([np.zeros((len(win), 1), dtype=np.int64), np.cumsum(win == 0, axis=1)], axis=1)
    first, last = ANCHOR, t  # where frames begin that hold the anchor, at t to t + ANCHOR
    good = gone[:, first + t : last + t + 1] - gone[:, first : last + 1] <= t // 4
    any_good = good.any(axis=1)
    low = first + good.argmax(axis=1)
    high = last - good[:, ::-1].argmax(axis=1) + t
    at = np.arange(win.shape[1])
    return np.flatnonzero(any_good), np.where((at >= low[:, None]) & (at < high[:, None]), win, 0)


def row_hashes(win: np.ndarray) -> np.ndarray:
    h = np.zeros(len(win), dtype=np.uint64)
    for k, column in enumerate(np.ascontiguousarray(win.T).view(np.uint64)):
        h = mix(h + column + np.uint64(k))
    return h.view(np.int64)


def list_column(b: pa.RecordBatch, name: str, *fields: str) -> tuple[np.ndarray, ...]:
    """(row, the fields) of each item of a column of lists of structs."""
    lists = b.column(name)
    items = lists.flatten()
    row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
    return row, *(items.field(items.type.get_field_index(x)).to_numpy() for x in fields)


def class_rows(b: pa.RecordBatch, t: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``CLASSES`` for the anchors that each row of a batch asks for, many documents' at a time: a step for each
    shingle around an anchor costs as much for one as for a thousand."""
    reach = t + EDGE
    ids, variant = b.column("doc_id").to_numpy(), b.column("variant").to_numpy()
    whose, sig, c = list_column(b, "asked", "sig", "c")
    row, place, h = list_column(b, "got", "place", "h")
    low, high = np.full(len(b), np.iinfo(np.int64).max), np.zeros(len(b), dtype=np.int64)
    for r, x in ((whose, c), (row, place)):
        np.minimum.at(low, r, x)
        np.maximum.at(high, r, x)
    size = high - low + 3 * reach + ANCHOR
    until = np.cumsum(size)
    first, last = 0, 0
    while first < len(b):
        last = max(first + 1, int(np.searchsorted(until, until[first] - size[first] + CLASS_PLACES)))
        shift = until - size - (until[first] - size[first]) - low + reach  # from a place in a text to one in ``own``
        own = np.zeros(int(until[last - 1] - until[first] + size[first]), dtype=np.int64)
        x, y = np.searchsorted(row, [first, last])
        own[shift[row[x:y]] + place[x:y]] = h[x:y]
        x, y = np.searchsorted(whose, [first, last])
        for k in range(x, y, CLASS_ROWS):
            some = slice(k, min(k + CLASS_ROWS, y))
            wide = own[(shift[whose[some]] + c[some] - reach)[:, None] + np.arange(2 * reach + ANCHOR)]
            on, counts = what_counts(wide[:, EDGE:-EDGE], t)
            columns = [x[some][on] for x in (sig, ids[whose], variant[whose], c)]
            columns.insert(1, row_hashes(counts)[on])
            raw = pa.array([x.tobytes() for x in wide[on].astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), raw], names=["sig", "around", *NAMES, "wide"])
        first = last


def classes(docs: DataFrame, many: DataFrame, t: int) -> DataFrame:
    """Rows of ``CLASSES`` for the anchors ``many``: ``around`` stands for those shingles near the anchor that documents
    share. ``wide`` has these in 32 bits and order, 0 for others, and ``EDGE`` more on both sides. Anchors of one class
    differ in what no other document has, so that each pair of them is as much alike as any other. Anchors near which no
    passage can be similar to another are left out."""
    asked = cut(many.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("sig", "c")).alias("asked")))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = [((i, v, a), s.encode("utf-8", "surrogatepass")) for i, v, s, a in zip(b["doc_id"], b["variant"], b["text"], b["asked"], strict=True)]
            for part in batched(items):
                g, starts = text_shingles([s for _, s in part])
                for k, ((i, v, a), _) in enumerate(part):
                    own = g[starts[k] : starts[k + 1]].view(np.int64)
                    c = np.fromiter((x["c"] for x in a), dtype=np.int64, count=len(a))
                    edge = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(edge, np.maximum(c - t, 0), 1)
                    np.add.at(edge, np.minimum(c + ANCHOR + t, len(own)), -1)
                    place = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                    yield pd.DataFrame({"h": own[place], "doc_id": i, "variant": v, "place": place})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from class_rows(b, t)

    who = F.struct("doc_id", "variant")
    texts = in_batches(split_join(docs, asked, ["doc_id", "variant"]).select("doc_id", "variant", "text", "asked"))
    shown = cut(texts.mapInPandas(near, "h long, doc_id long, variant long, place long"))
    shared = shown.groupBy("h").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a != b").select("h")
    kept = split_join(shown, shared, ["h"]).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("place", "h")).alias("got"))
    return in_batches(kept.join(asked, ["doc_id", "variant"])).mapInArrow(judge, CLASSES)


def covered(has: np.ndarray, wide: np.ndarray, t: int, a: int = 0, b: int | None = None) -> np.ndarray:
    """Which words of the shingles ``has`` lie in a passage that it shares with ``wide``, looked for from ``a`` to ``b``."""
    own = np.where(has == 0, (1 << 40) + np.arange(len(has)), has)
    src = np.where(wide == 0, (1 << 41) + np.arange(len(wide)), wide)
    return words_of(passages(own[a:b], src, -EDGE - a, t, SIMILARITY), len(has), a)


def words_of(found: list[tuple], n: int, a: int = 0) -> np.ndarray:
    """Which words of n shingles lie in the passages, whose places count from ``a``."""
    out = np.zeros(n + SHINGLE - 1, dtype=bool)
    for first, last, *_ in found:
        out[a + first : a + last + SHINGLE] = True
    return out


def sought(has: np.ndarray, done: np.ndarray) -> np.ndarray:
    """Which words a passage could still add: those from the first shared shingle to the last that are not ``done``."""
    at = np.flatnonzero(has)
    word = np.arange(len(done))
    return ~done & (word >= at[0]) & (word < at[-1] + SHINGLE) if len(at) else np.zeros(len(done), dtype=bool)


def once(x: np.ndarray) -> np.ndarray:
    """Which shingles stand once in their row; 0 is another one at each place."""
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, axis=1)
    same = np.zeros((len(x), x.shape[1] + 1), dtype=bool)
    same[:, 1:-1] = (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] != 0)
    out = np.empty(x.shape, dtype=bool)
    np.put_along_axis(out, order, ~(same[:, 1:] | same[:, :-1]), axis=1)
    return out


def within_reach(first_at: np.ndarray, last_at: np.ndarray, single: np.ndarray, lacks: np.ndarray, t: int) -> np.ndarray:
    """Which words a similar passage of t shingles or more that holds the anchor can reach. ``first_at`` and ``last_at`` have a
    row for each partner: where it has each shingle first and last, or -1; ``lacks``: how many of its shingles before each
    place are not shared. What one of both lacks in such a passage is a quarter of what both have at most. Shingles that
    repeat (in ``single`` those that don't) count as lacking nowhere and as shared at each place, so that the bound holds."""
    hit, n = first_at >= 0, first_at.shape[1]
    level = np.cumsum(np.where(hit, 1, np.where(single, -4, 0)), axis=1, dtype=np.int32)
    lacks_to = lambda at: 4 * np.take_along_axis(lacks, np.maximum(at, 0), axis=1)
    far = np.int32(1 << 20)
    end = np.where(hit, level - lacks_to(first_at), -far)
    best_end = np.maximum.accumulate(end[:, ::-1], axis=1)[:, ::-1]  # of all that end there or later
    start = np.where(hit, level - 1 - lacks_to(last_at), far)  # without the first shingle itself
    best_start = np.minimum.accumulate(start, axis=1)
    first, last = np.arange(t + 1), np.arange(t + ANCHOR - 1, n)
    start_good = best_end[:, np.maximum(t + ANCHOR, first + t) - 1] >= start[:, first]
    end_good = best_start[:, np.minimum(t, last + 1 - t)] <= end[:, last]
    low = np.where(start_good.any(axis=1), start_good.argmax(axis=1), n)
    high = np.where(end_good.any(axis=1), n - end_good[:, ::-1].argmax(axis=1), 0)
    word = np.arange(n + SHINGLE - 1)
    return (word >= low[:, None]) & (word < high[:, None] + SHINGLE - 1) & (low < high)[:, None]


def partners(own: list[np.ndarray], wide: np.ndarray, done: np.ndarray, src: list[np.ndarray], src_wide: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``own``, rows of ``src``): for each of ``own``, earlier ones of ``src`` until none can add a word to the
    passages found; ``done`` tells what was found before. What is around an anchor is all that a link shows of two texts,
    so that a partner with which it holds no passage is not linked."""
    _, has = what_counts(wide[:, EDGE:-EDGE], t)
    order = np.lexsort(src[::-1])
    src, src_wide = [x[order] for x in src], src_wide[order]
    kinds = np.unique(src_wide)
    kinds = kinds[kinds != 0]
    rows, found = [], []
    if not len(kinds):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    number = np.where(src_wide == 0, len(kinds), np.searchsorted(kinds, src_wide))
    row, at = np.nonzero(src_wide)
    where = np.full((len(kinds) + 1, len(src_wide)), -1, dtype=np.int16)  # the last for what none has
    where[number[row, at], row] = at
    own_once, src_once = once(has), once(src_wide)
    own_repeats, src_repeats = ~own_once.all(axis=1), ~src_once.all(axis=1)
    first_where = where
    if src_repeats.any():
        first_where = where.copy()
        first_where[number[row, at][::-1], row[::-1]] = at[::-1]
    for k in range(len(has)):
        i, v = own[0][k], own[1][k]
        todo = sought(has[k], done[k])
        seen = np.minimum(np.searchsorted(kinds, has[k]), len(kinds) - 1)
        seen = np.where((has[k] != 0) & (kinds[seen] == has[k]), seen, len(kinds))
        here = where[seen]
        use = np.flatnonzero(((src[0] < i) | ((src[0] == i) & (src[1] < v))) & (np.count_nonzero(here >= 0, axis=0) >= SIMILARITY * t))
        if not len(use):
            continue
        mine = np.zeros(len(kinds) + 1, dtype=bool)
        mine[seen] = True
        mine[-1] = False
        lacks = np.zeros((len(use), src_wide.shape[1] + 1), dtype=np.int32)
        np.cumsum(~mine[number[use]] & src_once[use], axis=1, out=lacks[:, 1:])
        place = np.ascontiguousarray(here[:, use].T)
        first_place = place if first_where is where else first_where[seen[:, None], use].T
        reach = within_reach(first_place, place, own_once[k], lacks, t)
        repeat = src_repeats[use] | own_repeats[k]

        def shared(j: int, a: int = 0, b: int | None = None) -> np.ndarray:
            if repeat[j]:
                return covered(has[k], src_wide[use[j]], t, a, b)
            return words_of(similar_runs(place[j, a:b], t, SIMILARITY), len(has[k]), a)

        while True:
            gain = (reach & todo).sum(axis=1)
            best = int(gain.argmax())
            if not gain[best]:
                break
            new = todo & shared(best)
            span = np.flatnonzero(reach[best])
            reach[best] = False
            # a passage may show only without what lies beside it; whether the texts show it so is left to their own check
            if new.any() or (todo & shared(best, int(span[0]), int(span[-1]) - SHINGLE + 2)).any():
                todo &= ~new
                rows.append(k)
                found.append(order[use[best]])
    return np.array(rows, dtype=np.int64), np.array(found, dtype=np.int64)


def class_links(heads: DataFrame, t: int) -> DataFrame:
    """(own, src): links of the heads of classes with earlier ones. Every head of a signature is held against the first one.
    Those with words outside the passages found so are held against all others, ``PACK`` against ``PACK`` in a
    row, and linked with as many as it takes to have every word that any of them can add. Rows grow with the heads
    (with the square of a group only by its packs), links with what they add. No group is limited."""
    place = "doc_id long, variant long, c long"
    width = 2 * (t + EDGE) + ANCHOR
    stacked = lambda x: np.frombuffer(b"".join(x), dtype=np.int32).reshape(-1, width).astype(np.int64)

    def against_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                wide, first = stacked(b["wide"]), stacked(b["first_wide"])
                _, has = what_counts(wide[:, EDGE:-EDGE], t)
                done = [covered(x, y, t) for x, y in zip(has, first, strict=True)]
                b["done"] = [x.tobytes() for x in done]
                b["seeks"] = [bool(sought(x, y).any()) for x, y in zip(has, done, strict=True)]
                yield b.drop(columns="first_wide")

    def each_pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                own, src = [np.asarray(x) for x in (r.doc_id, r.variant, r.c)], [np.asarray(x) for x in (r.src_id, r.src_variant, r.src_c)]
                done = np.frombuffer(b"".join(r.done), dtype=bool).reshape(len(own[0]), -1)
                row, at = partners(own, stacked(r.wide), done, src, stacked(r.src_wide), t)
                yield pd.DataFrame(dict(zip(("doc_id", "variant", "c", "src_id", "src_variant", "src_c"), [*(x[row] for x in own), *(x[at] for x in src)], strict=True)))

    firsts = heads.groupBy("sig").agg(F.min(F.struct("own", "wide")).alias("first"), F.count("*").alias("n"))
    held = split_join(heads, firsts, ["sig"]).where("own != first.own")
    own, src = F.struct(*NAMES), F.struct(F.col("src_id").alias("doc_id"), F.col("src_variant").alias("variant"), F.col("src_c").alias("c"))
    held = held.select("sig", "n", "own.*", "wide", F.col("first.own.doc_id").alias("src_id"), F.col("first.own.variant").alias("src_variant"), F.col("first.own.c").alias("src_c"), F.col("first.wide").alias("first_wide"))
    held = cut(in_batches(held).mapInPandas(against_first, f"sig long, n long, {place}, wide binary, src_id long, src_variant long, src_c long, done binary, seeks boolean"))
    packs = F.ceil(F.col("n") / PACK)
    held = held.withColumn("packs", packs).withColumn("pack", F.pmod(F.xxhash64(*NAMES), F.col("packs")))
    lists = [F.collect_list(x).alias(x) for x in (*NAMES, "wide")]
    seekers = held.where("seeks").groupBy("sig", "pack").agg(F.first("packs").alias("packs"), *lists, F.collect_list("done").alias("done"))
    seekers = seekers.select("sig", *NAMES, "wide", "done", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)).alias("pack"))
    others = held.groupBy("sig", "pack").agg(F.max("seeks").alias("sought"), *lists)
    others = others.select("sig", "pack", F.col("doc_id").alias("src_id"), F.col("variant").alias("src_variant"), F.col("c").alias("src_c"), F.col("wide").alias("src_wide"))
    met = split_join(seekers, others, ["sig", "pack"]).drop("sig", "pack")
    more = in_batches(met).mapInPandas(each_pair, f"{place}, src_id long, src_variant long, src_c long")
    return held.select(own.alias("own"), src.alias("src")).unionByName(more.select(own.alias("own"), src.alias("src")))


def near_links(docs: DataFrame, t: int, functions: int) -> DataFrame:
    """Rows like those of ``links``, without a bound on a place's partners: any two documents that have an anchor in common
    are linked there, or each with the first document that is the same around it.

    Anchors equal with all around them stand for one: their passages are equal, which ``equal_links`` joins. All others of
    one signature are linked in pairs, if they are ``FEW`` or fewer. If they are more, ``classes`` tells them apart by what
    documents share; each is linked with the first of its class, and ``class_links`` links the first ones of classes."""
    often = cut(anchors(docs, t).groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig"))
    found = split_join(anchors(docs, t), often, ["sig"])
    own = F.struct(*NAMES)
    firsts = lambda rows: rows.groupBy("sig", "around").agg(F.min(own).alias("own"))
    found = cut(firsts(found))
    sizes = found.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    found = cut(split_join(found, sizes, ["sig"]))
    listed = found.where(F.col("n") <= FEW).groupBy("sig").agg(F.sort_array(F.collect_list("own")).alias("all"))
    pairs = listed.select("all", F.posexplode("all").alias("k", "own")).where("k > 0").select("own", F.explode(F.slice("all", F.lit(1), F.col("k"))).alias("src"))
    many = found.where(F.col("n") > FEW).select("sig", "own.*")
    if not many.isEmpty():
        rows = cut(classes(docs, many, t))
        first = F.min(F.struct(own.alias("own"), "wide")).alias("first")
        heads = cut(rows.groupBy("sig", "around").agg(first).select("sig", "around", "first.*"))
        member = split_join(rows, heads.select("sig", "around", F.col("own").alias("src")), ["sig", "around"]).select(own.alias("own"), "src")
        pairs = pairs.unionByName(member).unionByName(class_links(heads, t))
    pairs = pairs.select("own.*", "src").where(apart())
    reach = [F.lit(t).cast("long").alias("lefts"), F.lit(t + ANCHOR - 1).cast("long").alias("rights")]
    src = F.struct(*(F.col(f"src.{n}").alias(n) for n in NAMES), *reach)
    return pairs.select(F.lit((1 << functions) - 1).alias("f"), *NAMES, *reach, src.alias("src"))


PAIR = ["doc_id", "variant", "src_id", "src_variant"]


def interval_pairs(linked: DataFrame, t: int, enough: int) -> DataFrame:
    """(doc_id, variant, a, b, src_id, src_variant, d, sa, sb): intervals of shingles, both ends included, that links along
    a diagonal join."""
    # only a stretch that repeats, or frames that are equal, reach t places beyond; a stretch may be longer than the source's and counts whole
    stretch = F.col("rights") >= t
    side = lambda by: F.when(stretch, F.col(by)).otherwise(F.least(F.col(by), F.col(f"src.{by}")))
    rows = linked.select("f", "doc_id", "variant", F.col("src.doc_id").alias("src_id"), F.col("src.variant").alias("src_variant"), (F.col("c") - side("lefts")).alias("a"), (F.col("c") + side("rights")).alias("b"), (F.col("c") - F.col("src.c")).alias("d"))
    rows = rows.where(F.col("b") - F.col("a") + 1 >= t - SLACK)
    by_diagonal = Window.partitionBy(*PAIR).orderBy("d", "a", "b", "f")
    jump = (F.col("d") - F.lag("d").over(by_diagonal) > SLACK).cast("int")
    rows = rows.withColumn("lane", F.sum(F.coalesce(jump, F.lit(0))).over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    lane = Window.partitionBy(*PAIR, "lane").orderBy("a", "b", "d", "f")
    gap = (F.col("a") > F.max("b").over(lane.rowsBetween(Window.unboundedPreceding, -1)) + 1).cast("int")
    rows = rows.withColumn("run", F.sum(F.coalesce(gap, F.lit(0))).over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy(*PAIR, "lane", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("d").alias("low"), F.max("d").alias("high"), F.bit_or("f").alias("f"))
    # runs whose distance and whose shift the words put in or left out of one passage can explain are one interval
    whole = F.greatest(F.sum(F.col("b") - F.col("a") + 1).over(Window.partitionBy(*PAIR)) * BREAK_SHARE, F.lit(SLACK))
    by_place = Window.partitionBy(*PAIR).orderBy("a", "b", "low")
    off = F.greatest(F.col("low") - F.lag("high").over(by_place), F.lag("low").over(by_place) - F.col("high"))
    far = (F.col("a") - F.max("b").over(by_place.rowsBetween(Window.unboundedPreceding, -1)) - 1 > whole) | (off > whole)
    joined = joined.withColumn("far", F.coalesce(far, F.lit(False)).cast("int"))
    joined = joined.withColumn("lane", F.sum("far").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*PAIR, "lane").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_count(F.bit_or("f")).alias("n"))
    a, b = F.greatest(F.col("a") - SLACK, F.lit(0)), F.col("b") + SLACK
    return joined.where(F.col("n") >= enough).select(
        "doc_id", "variant", a.alias("a"), b.alias("b"), "src_id", "src_variant",
        F.col("low").alias("d"), F.greatest(a - F.col("high"), F.lit(0)).alias("sa"), F.greatest(b - F.col("low"), F.lit(0)).alias("sb"),
    )


def cells_of(a: str, b: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.col(b) / CELL)))


def cells(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, variant, cell, hashes) of the cells that some pair needs; ``wanted`` has (doc_id, variant, cells), a row for
    each document concerned, whose number of cells its length bounds. Hashes are cut to 32 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = [((i, v, c), s.encode("utf-8", "surrogatepass")) for i, v, s, c in zip(b["doc_id"], b["variant"], b["text"], b["cells"], strict=True)]
            for part in batched(items):
                g, starts = text_shingles([s for _, s in part])
                g = g.astype(np.uint32).view(np.int32)
                rows = [
                    (i, v, cell, own[CELL * cell : CELL * (cell + 1)].tobytes())
                    for k, ((i, v, asked), _) in enumerate(part)
                    for own in (g[starts[k] : starts[k + 1]],)
                    for cell in asked
                    if CELL * cell < len(own)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "variant", "cell", "hashes"])

    asked = split_join(docs, wanted, ["doc_id", "variant"]).select("doc_id", "variant", "text", "cells")
    return in_batches(asked).mapInPandas(run, "doc_id long, variant long, cell long, hashes binary")


def passages(own: np.ndarray, src: np.ndarray, shift: int, t: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, source start, source end, similarity) of the runs of ``own`` that ``src`` has too, ends included.

    A shingle that ``src`` has several times is taken where the diagonal ``shift`` has it, if it does."""
    if len(own) < t or len(src) < t:
        return []
    order = np.argsort(src, kind="stable")
    ordered = src[order]
    at = np.minimum(np.searchsorted(ordered, own), len(src) - 1)
    found = ordered[at] == own
    there = np.where(found, order[at], -1)
    new = ordered[1:] != ordered[:-1]
    mine = np.sort(own)
    if new.all() and (mine[1:] != mine[:-1]).all():
        return similar_runs(there, t, similarity)
    kind = np.zeros(len(src), dtype=np.int64)  # where each shingle of ``src`` stands first in order, as ``at`` has it
    kind[order] = np.maximum.accumulate(np.concatenate([[0], np.where(new, np.arange(1, len(src)), 0)]))
    before = np.full(len(own), -1)  # where the same shingle stood last
    place = np.argsort(own, kind="stable")
    again = np.flatnonzero(own[place[1:]] == own[place[:-1]])
    before[place[again + 1]] = place[again]
    across = np.arange(len(own)) - shift
    on = np.flatnonzero((across >= 0) & (across < len(src)))
    on = on[src[across[on]] == own[on]]
    there[on] = across[on]
    return similar_runs(there, t, similarity, (np.where(found, at, -1), kind, before))


def similar_runs(there: np.ndarray, t: int, similarity: float, repeats: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, float]]:
    """What ``passages`` tells of a text whose shingles lie at the places ``there`` of the other (-1: nowhere). If shingles
    repeat, ``repeats`` numbers those of both alike (-1: the other has none), and has the place before where the text has
    the same one. If none does, places tell how many there are."""
    hit = np.flatnonzero(there >= 0)
    if len(hit) < similarity * t:
        return []

    def alike_in(a: int, b: int, sa: int, sb: int) -> float:
        if repeats is None:
            within = there[a : b + 1]
            both, mine, others = np.count_nonzero((within >= sa) & (within <= sb)), b - a + 1, sb - sa + 1
        else:
            own, src, before = repeats
            one, other = np.zeros(len(src) + 1, dtype=bool), np.zeros(len(src) + 1, dtype=bool)
            one[own[a : b + 1]] = True
            one[-1] = False
            other[src[sa : sb + 1]] = True
            both, mine, others = np.count_nonzero(one & other), np.count_nonzero(before[a : b + 1] < a), np.count_nonzero(other)
        return both / (mine + others - both)

    out, todo = [], [hit]
    while todo:
        run = todo.pop()
        if not len(run) or run[-1] - run[0] + 1 < t:
            continue
        if repeats is None and len(run) < len(hit) and (np.searchsorted(hit, run[-1]) - np.searchsorted(hit, run[0]) + 1) / t < similarity:
            continue  # no part of it has enough
        theirs = there[run]
        shift_here = run - theirs
        reach = max(SHIFT, int(BREAK_SHARE * len(run)))
        if shift_here.max() - shift_here.min() <= reach:
            near, sa, sb = run, int(theirs.min()), int(theirs.max())
        else:
            near = run[np.abs(shift_here - np.sort(shift_here)[len(run) // 2]) <= reach]  # holds one at least
            sa, sb = int(there[near].min()), int(there[near].max())
            near = run[(theirs >= sa) & (theirs <= sb)]  # what repeats in ``own`` lies on other diagonals too
        a, b = int(near[0]), int(near[-1])
        alike = alike_in(a, b, sa, sb)
        if b - a + 1 >= t and alike >= similarity:
            if repeats is not None:  # what the source's interval has too, though it was taken for another place of the source
                same = run[np.isin(repeats[0][run], repeats[1][sa : sb + 1])]
                wider = alike_in(int(same[0]), int(same[-1]), sa, sb)
                if wider >= similarity:
                    a, b, alike = int(same[0]), int(same[-1]), wider
            out.append((a, b, sa, sb, alike))
            todo += [run[run < a], run[run > b]]
            continue
        gaps = np.diff(run)
        if len(gaps) and gaps.max() > 1:  # too unlike as a whole; its parts on both sides of the widest gap may not be
            widest = int(gaps.argmax()) + 1
            todo += [run[:widest], run[widest:]]
        elif len(near) < len(run):  # parts without a gap that lie on other diagonals
            todo += np.split(run, np.flatnonzero(np.abs(np.diff(shift_here)) > reach) + 1) if (np.abs(np.diff(shift_here)) > reach).any() else [near]
    return sorted(out)


def verified(pairs: DataFrame, cut_up: DataFrame, t: int, similarity: float) -> DataFrame:
    """A row for each verified passage. A pair gets its own cells only, as many as its intervals are long."""
    ask = lambda id_, v, a, b, side: pairs.select("pair", F.col(id_).alias("doc_id"), F.col(v).alias("variant"), F.lit(side).alias("side"), cells_of(a, b).alias("cell"))
    asked = ask("doc_id", "variant", "a", "b", 0).unionByName(ask("src_id", "src_variant", "sa", "sb", 1))
    got = asked.join(cut_up, ["doc_id", "variant", "cell"]).groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("side", "cell", "hashes"))).alias("got"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                side = [[], []]
                for x in r.got:
                    side[x["side"]].append((x["cell"], x["hashes"]))
                if not all(side):
                    continue
                own, src = (np.frombuffer(b"".join(h for _, h in s), dtype=np.int32) for s in side)
                base, src_base = (CELL * s[0][0] for s in side)
                for a, e, sa, se, alike in passages(own, src, r.d - base + src_base, t, similarity):
                    rows.append((r.doc_id, r.variant, base + a, base + e + SHINGLE, r.src_id, r.src_variant, src_base + sa, src_base + se + SHINGLE, alike))
            yield pd.DataFrame(rows, columns=["doc_id", "variant", "start", "stop", "source_id", "source_variant", "source_start", "source_stop", "similarity"])

    joined = pairs.select("pair", *PAIR, "d").join(got, "pair")
    return in_batches(joined).mapInPandas(run, "doc_id long, variant long, start long, stop long, source_id long, source_variant long, source_start long, source_stop long, similarity double")


def text_variant(text: str) -> Column:
    """A text's hash, never 0."""
    return F.coalesce(F.nullif(F.xxhash64(text), F.lit(0)), F.lit(1)).cast("long")


def distinct_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, variant, text): each text of each id once. Ids that occur once, nearly all, are not dealt out for that."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = docs.select(F.col(key).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    twice = cut(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    single = rows.withColumn("variant", F.lit(0).cast("long"))
    if twice.isEmpty():
        return single.select("doc_id", "variant", "text")
    again = split_join(rows, twice, ["doc_id"]).withColumn("variant", text_variant("text"))
    texts = again.groupBy("doc_id", "variant").agg(F.min("text").alias("text"))
    several = texts.groupBy("doc_id").agg(F.count("*").alias("n"))
    texts = split_join(texts, several, ["doc_id"]).select("doc_id", F.when(F.col("n") > 1, F.col("variant")).otherwise(F.lit(0).cast("long")).alias("variant"), "text")
    return single.join(twice, "doc_id", "left_anti").select("doc_id", "variant", "text").unionByName(cut(texts))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", passage_words: int = PASSAGE_WORDS, functions: int = FUNCTIONS, enough: int = ENOUGH, similarity: float = SIMILARITY, hot: list[int] | None = None) -> DataFrame:
    """Passages of ``passage_words`` words or more that repeat one of a document with a smaller id. ``hot`` is the list of
    ``hot_signatures``, taken from a sample if it is not given."""
    t = passage_words - SHINGLE + 1
    rows = distinct_documents(docs, key, text)
    hot = hot_signatures(rows, docs.count(), t) if hot is None else hot
    equal = cut(equal_links(rows, t, functions, hot))  # few rows, whose shuffles of all frames go before the next begin
    near = cut(near_links(rows, t, functions))
    linked = links(windows(rows, t, functions)).unionByName(equal).unionByName(near)
    pairs = cut(interval_pairs(linked, t, enough).withColumn("pair", F.monotonically_increasing_id()))
    span = lambda id_, v, a, b: pairs.select(F.col(id_).alias("doc_id"), F.col(v).alias("variant"), cells_of(a, b).alias("cell"))
    wanted = span("doc_id", "variant", "a", "b").union(span("src_id", "src_variant", "sa", "sb")).groupBy("doc_id", "variant").agg(F.collect_set("cell").alias("cells"))
    out = verified(pairs, cut(cells(rows, wanted)), t, similarity)
    return out.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "source_id", "source_start", "source_stop", "similarity", "variant", "source_variant").distinct()


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans and the white space that follows them."""
    raw = text.encode("utf-8", "surrogatepass")
    w = Words([raw])
    start, n = w.start - 1, len(w.start)  # the buffer begins with a newline
    out, done = [], 0
    for a, b in sorted(spans):
        if a >= n:
            continue
        begin, end = int(start[a]), int(start[b]) if b < n else len(raw)
        if end > done:
            out.append(raw[done : max(done, begin)])
            done = end
    out.append(raw[done:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def cut_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` with each repeated passage left in its first document only; documents without one keep their text as it
    is. ``length`` names a column that counts the text's characters, if there is one. A row is cut where its own text
    repeats another: rows that share an id and differ in text are cut each at their own places, rows equal in both alike.
    Rows without an id or a text stay as they are; an empty table gives an empty table; extra columns pass through,
    whatever their names."""
    id_, variant, spans = fresh(docs, "__id"), fresh(docs, "__variant"), fresh(docs, "__spans")
    found = repeated_passages(docs, key, text, **how).groupBy(F.col("doc_id").alias(id_), F.col("variant").alias(variant)).agg(F.collect_set(F.struct("start", "stop")).alias(spans))

    @F.pandas_udf("string")
    def shorter(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or y is None else without_spans(x, [(p["start"], p["stop"]) for p in y]) for x, y in zip(t, s, strict=True)], dtype=object)

    own = (docs[key].cast("long") == found[id_]) & ((found[variant] == 0) | (found[variant] == F.coalesce(F.nullif(F.xxhash64(docs[text]), F.lit(0)), F.lit(1))))
    joined = in_batches(docs.join(found, own, "left"))
    out = joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(shorter(F.col(text), F.col(spans))))
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(F.col(spans).isNull(), F.col(length)).otherwise(F.length(text).cast(docs.schema[length].dataType)))
    return out.select(*docs.columns)
