"""Near duplicates: bottom-k sketches from one hash function, inverted lists, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import Scratch, WordHashes, lower_words, mix, pack, shingles, text_key, unpack
from acreage.llm.graph import components

WIDTH, SKETCH = 5, 64
# Of a sketch of 64, a pair at a similarity of 0.75 shares 48 values on average; fewer than 30 has a chance of about one in a million
AT_LEAST = 30
# An estimate from the union sketch is 0.75 +- 0.054; pairs below this are not read
ESTIMATE = 0.5
ROUNDS, BLOCK = 6, 512
CROWD = 4
# A round of hubs that links a smaller share of its pairs is the last; blocks decide the rest
WORTH = 0.5

_SKETCHED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def class_key(found: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    with np.errstate(over="ignore"):
        return b"".join(int(mix(found ^ np.uint64(seed)).sum(dtype=np.uint64)).to_bytes(8, "big") for seed in (0x51ED270B, 0x2545F491))


def _sketch(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        counts, keys, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(cache.of(lower_words(text)), width)
            counts.append(len(found))
            keys.append(class_key(found) if len(found) else None)
            sketches.append(found[:size].view(np.int64) if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                                          pa.array(sketches, pa.list_(pa.int64()))], schema=_SKETCHED)


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        sets = [pack(shingles(cache.of(lower_words(text)), width)) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], names=["cls", "members"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of whole sets, each with the 64-bit name of its class."""
    for batch in batches:
        sets = [unpack(x) for x in batch.column("members").to_pylist()]
        if sets:
            names = np.repeat(batch.column("name").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(names)], names=["value", "name"])


def estimate(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of the union's smallest ``size`` values that both sketches hold; exact if both sketches are whole sets."""
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:size]
    return np.isin(both, union, assume_unique=True).sum() / max(1, len(union))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last, one = [], None, None
        for i, (left, right) in enumerate(zip(batch.column("members").to_pylist(), batch.column("hub_members").to_pylist())):
            if right != last:
                last, one = right, unpack(right)
            two = unpack(left)
            if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)) or estimate(one[:size], two[:size], size) < ESTIMATE:
                continue
            shared = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * shared >= percent * (len(one) + len(two) - shared):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


_NAMED = ["a", "b", "crowd", "value", "x", "y"]
Block = dict[str, np.ndarray]  # the columns of a block's rows


def _fitting(group: Block, percent: int, once: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Which pairs of one part of a list with another, or with itself, have different components, sizes that allow a link, and enough values in common; the sketches; the values in common.

    ``once``: a pair that meets in several lists counts in the list of the smallest value only.
    """
    rows = [np.asarray(x, np.int64).view(np.uint64) for x in group["sketch"]]
    own, n = group["own"], group["n"]
    _, comps = np.unique(group["comp"], return_inverse=True)
    ks = np.array([len(x) for x in rows])
    flat = np.concatenate(rows)
    values, where, often = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[where]
    who = np.repeat(np.arange(len(rows)), ks)

    def shared(chosen: np.ndarray) -> np.ndarray:
        chosen = chosen & (place >= 0)
        held = np.zeros((len(rows), int((often > 1).sum())), np.float32)
        held[who[chosen], place[chosen]] = 1
        return held @ held.T
    common = shared(np.ones(len(flat), bool))
    fits = np.triu(common >= ESTIMATE * np.maximum.outer(ks, ks), 1) & (comps[:, None] != comps)
    fits &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    if "room" in group:
        fits &= (n <= group["room"][:, None]) & (n[:, None] <= group["room"])
    if once:
        value = np.int64(group["value"][0]).view(np.uint64)
        prefix = np.concatenate([np.unpackbits(np.array([m], np.int64).view(np.uint8), bitorder="little")[:k].astype(bool) for m, k in zip(group["prefix"], ks)])
        fits &= shared(prefix & (flat < value)) == 0
    if group["x"][0] != group["y"][0]:
        fits &= own[:, None] != own
    return fits, rows, common


def _pairs_in_block(group: Block, size: int, percent: int) -> list[tuple]:
    """Pairs of a block whose estimate passes. A block with more than ``CROWD`` fitting pairs for each member names no pairs, but itself as a crowd."""
    fits, rows, _ = _fitting(group, percent, True)
    keys = group["cls"]
    block = tuple(group[c][0] for c in ("value", "x", "y"))
    if fits.sum() > CROWD * len(rows):
        return [(None, None, True, *block)]
    return [(keys[i], keys[j], False, *block) for i, j in zip(*np.nonzero(fits)) if estimate(rows[i], rows[j], size) >= ESTIMATE]


def _candidates_in_block(group: pd.DataFrame, size: int, percent: int) -> pd.DataFrame:
    return pd.DataFrame(_pairs_in_block({c: group[c].to_numpy() for c in group}, size, percent), columns=_NAMED)


def _links_in_block(group: Block, size: int, percent: int) -> list[tuple]:
    """Links between members of a block, by their whole sets; one for each two components that become one, those with the most common values first."""
    fits, rows, common = _fitting(group, percent, True)
    keys, packed, sets = group["cls"], group["members"], {}
    _, comps = np.unique(group["comp"], return_inverse=True)
    root = list(range(len(rows)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c
    out = []
    i, j = np.nonzero(fits)
    for at in np.argsort(-common[i, j], kind="stable"):
        left, right = int(i[at]), int(j[at])
        one, two = find(int(comps[left])), find(int(comps[right]))
        if one == two or estimate(rows[left], rows[right], size) < ESTIMATE:
            continue
        for k in (left, right):
            if k not in sets:
                sets[k] = unpack(packed[k])
        both = len(np.intersect1d(sets[left], sets[right], assume_unique=True))
        if 100 * both >= percent * (len(sets[left]) + len(sets[right]) - both):
            out.append((keys[left], keys[right]))
            root[one] = two
    return out


def _by_block(frames: Iterator[pd.DataFrame], judge, names: list[str]) -> Iterator[pd.DataFrame]:
    """``judge`` of each block of rows that come sorted by block; only the rows of an unfinished block are carried on to the next frame."""
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        columns = {c: rest[c].to_numpy() for c in rest}
        new = np.zeros(len(rest) - 1, bool)
        for c in ("value", "x", "y"):
            new |= columns[c][1:] != columns[c][:-1]
        bounds = [0, *(np.flatnonzero(new) + 1)]
        if len(bounds) > 1:
            yield pd.DataFrame([row for a, b in zip(bounds, bounds[1:]) for row in judge({c: v[a:b] for c, v in columns.items()})], columns=names)
            rest = rest.iloc[bounds[-1]:]
    if rest is not None:
        yield pd.DataFrame(judge({c: rest[c].to_numpy() for c in rest}), columns=names)


def _candidates(frames: Iterator[pd.DataFrame], size: int, percent: int) -> Iterator[pd.DataFrame]:
    return _by_block(frames, lambda block: _pairs_in_block(block, size, percent), _NAMED)


def _bounds(members: DataFrame, full: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(cls, n, room) of the members of lists that may have a link to another: the size, and the largest size that a linked set can have.

    A value that no other member holds is in no intersection. So two sets have at most the smaller number of values held elsewhere in common, and a link needs
    ``percent`` / (100 + ``percent``) of both sizes.
    """
    names = members.select("cls").distinct()
    spread = full.join(names.hint("merge"), "cls").select(F.xxhash64("cls").alias("name"), "members").mapInArrow(_spread, "value long, name long")
    own = spread.groupBy("value").agg(F.count("*").alias("times"), F.first("name").alias("name")).filter("times = 1").groupBy("name").agg(F.count("*").alias("own"))
    held = F.col("n") - F.coalesce("own", F.lit(0))
    return names.join(classes.select("cls", "n"), "cls").join(own, F.xxhash64("cls") == F.col("name"), "left").filter(100 * held >= percent * F.col("n")) \
        .select("cls", "n", (F.floor(held * (100 + percent) / percent) - F.col("n")).alias("room"))


def _dealt(members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(value, cls, comp, n, room, own, x, y): in each list the members outside its largest component meet all others whose sizes allow a link, block by block; inside a component nothing is open.

    A list of more than ``BLOCK`` members is cut into blocks: members outside by their room, those inside by their size. Members meet a block only if its smallest set fits their room and its largest
    room fits their set, so sets without a partner of their size meet no block.
    """
    shares = members.groupBy("value", "comp").agg(F.count("*").alias("n")).groupBy("value").agg(
        F.max_by("comp", "n").alias("main"), F.max("n").alias("inside"), F.sum("n").alias("length")).filter("inside < length")
    outside = F.col("comp") != F.col("main")
    side = F.when(outside, F.col("length") - F.col("inside")).otherwise(F.col("inside"))
    # steps of a hundredth, or so wide that the sizes about one set's make one block for each BLOCK members
    step = F.floor(100 * F.log(F.greatest(F.lit(1), F.when(outside, F.col("room")).otherwise(F.col("n")))) / F.greatest(F.lit(1.0), 58 * BLOCK / side))
    sized = scratch.put(members.join(shares, "value").select("value", "cls", "comp", "n", "room", (F.col("length") > BLOCK).alias("long"), outside.alias("outside"),
                                                             F.shiftleft(step + F.when(outside, 0).otherwise(1 << 20), 32).alias("at")))
    whole = sized.filter("not long").select("value", "cls", "comp", "n", "room", *(F.lit(0).cast("long").alias(c) for c in ("own", "x", "y")))
    long = sized.filter("long")
    blocks = scratch.put(long.groupBy("value", "at", "outside").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room"))
                         .groupBy("value").agg(F.collect_list(F.struct("at", "outside", "parts", "low", "high", "room")).alias("blocks")))
    met = F.filter("blocks", lambda y: (F.col("outside") | y["outside"]) & (y["low"] <= F.col("room")) & (y["room"] >= F.col("n")) & (100 * y["high"] >= percent * F.col("n")))
    others = F.flatten(F.transform(met, lambda y: F.sequence(y["at"], y["at"] + y["parts"] - 1)))
    own = F.col("at") + F.pmod(F.xxhash64("cls"), F.filter("blocks", lambda y: y["at"] == F.col("at"))[0]["parts"])
    apart = long.join(blocks, "value").withColumn("own", own).select("value", "cls", "comp", "n", "room", "own", F.explode(others).alias("other")) \
        .select("value", "cls", "comp", "n", "room", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return whole.unionAll(apart)


def grouped(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = 75, size: int = SKETCH, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(key, text_key, n_shingles, component_id, first): the group of each document under links of near-equal texts.

    A document's set are its distinct runs of ``width`` words (A-Z in lower case; a shorter text is one run). Two documents are linked if
    100 * |intersection| >= ``percent`` * |union|; component_id is the smallest id that can be reached. ``text_key``, a hash of the text, names a row together with the id; first marks one row
    of each group (and its equals): of those with the smallest id, the one whose set comes first, in it the smallest text key. A text without words is a group of its own.

    1. One pass hashes the runs with one hash function and retains the smallest ``size`` values. Documents with equal sets become one class, so copies
       never meet in pairs.
    2. Each retained value has an inverted list of classes. Values are ordered by the length of their lists: two sketches that share at
       least t of their values share one among the (size - t + 1) with the shortest lists, so longer lists need not be read. t is exact for sets of up to
       48 runs and has a chance of one in a million to lose a pair beyond, see AT_LEAST.
    3. In rounds, as long as they link a tenth of their pairs, each list compares its members with one of them, a hub that its hash picks: candidates are linear in the list. Before each pair is read in full,
       the estimate from the union of both sketches must pass; the exact sets decide. Lists whose members are all connected are done.
    4. Of what a few rounds leave, a set with too few values that any other set of an open list holds has no link (exact, by whole sets). The rest is compared in blocks of 512 x 512 sketches: in
       each list, the members outside its largest component with those others whose size and number of values held elsewhere allow a link. Only pairs
       that the estimate passes leave a block, each once, and the exact sets decide.
    5. A block with more than ``CROWD`` such pairs for each member (many variants of one text, most of them too far apart) names itself instead. Such blocks are read again with
       whole sets, the exact sets decide where they lie, and only links that join two components leave a block. So what is written is linear in the block's size.

    Texts without words (null, empty, white space) have 0 shingles and are linked with nothing; their component is their own id. Rows that share an
    id are documents of their own that show the same id. A null id takes part in linking, but never names a component unless nothing else does; its row is
    first, or kept, only if its group has no other id. Further columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("binary").alias("text"))
    sketched = scratch.put(rows.mapInArrow(lambda it: _sketch(it, width, size), "doc_id long, text_key long, n_shingles long, cls binary, sketch array<long>"))
    classes = scratch.put(sketched.filter("cls is not null").groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("low"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")).select(
            "cls", F.col("low.doc_id").alias("doc_id"), F.col("low.text_key").alias("text_key"), "sketch", "n"))

    # inverted lists: values that two classes retain, then each class's values with the shortest lists
    posted = classes.select("cls", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    lengths = scratch.put(posted.groupBy("value").agg(F.count("*").alias("length")).filter("length > 1"))
    needed = F.when(F.col("k") <= ceil(size * percent / 100), F.ceil(F.col("k") * percent / 100)).otherwise(F.floor(F.col("k") * (AT_LEAST / SKETCH)))
    held = posted.join(lengths, "value").groupBy("cls", "k").agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("held"))
    prefix = F.size("held") - needed + 1  # values that no other class retains come first and take their share of the prefix
    central = F.size("held") / F.col("k")
    lists = scratch.put(held.filter(prefix > 0).select("cls", central.alias("central"), F.explode(F.slice("held", 1, prefix.cast("int"))["value"]).alias("value")))
    several = scratch.put(lists.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").select("value"))
    lists = scratch.put(lists.join(several, "value"))

    # full sets of the classes in lists, from one document of each; the merge hints keep one plan for every size
    wanted = scratch.put(lists.select("cls").distinct().join(classes.drop("sketch", "n"), "cls"))
    full = scratch.put(rows.alias("r").join(wanted.hint("merge").alias("w"), F.col("r.text_key").eqNullSafe(F.col("w.text_key")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")))
                       .select("cls", "text").mapInArrow(lambda it: _full_sets(it, width), "cls binary, members binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = pairs.hint("merge").join(full.withColumnRenamed("cls", "a"), "a").join(full.select(F.col("cls").alias("b"), F.col("members").alias("hub_members")).hint("merge"), "b")
        return scratch.put(near.select("a", "b", "members", "hub_members").mapInArrow(lambda it: _confirm(it, percent, size), "a binary, b binary"))

    def labelled() -> DataFrame:
        return lists.join(roots, F.col("cls") == F.col("node"), "left").select("value", "cls", "central", F.coalesce("root", "cls").alias("comp"))

    links = scratch.put(lists.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0))
    roots = scratch.put(links.select(F.col("a").alias("node"), F.col("b").alias("root")))
    n_lists = lists.count()
    open_lists = True
    for turn in range(ROUNDS):
        members = scratch.put(labelled(), n_lists)
        # the first hub is the member with the largest share of values that others retain, which variants of one text are most like
        place = F.struct(F.lit(0.0) if turn else F.col("central"), F.xxhash64("cls", F.lit(turn)))
        hubs = scratch.put(members.groupBy("value").agg(F.max_by(F.struct("cls", "comp"), place).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                           .filter("lo <> hi").select("value", F.col("hub.cls").alias("b"), F.col("hub.comp").alias("hub_comp")), n_lists)
        pairs = scratch.put(members.join(hubs, "value").filter("comp <> hub_comp").select(F.col("cls").alias("a"), "b").distinct(), n_lists)
        if pairs.isEmpty():
            open_lists = False
            break
        found = confirmed(pairs)
        if found.isEmpty():
            break
        links = links.unionAll(found)
        roots = scratch.put(components(links, scratch), 2 * links.count())
        if found.count() < WORTH * pairs.count():
            break
    if open_lists:
        members = scratch.put(labelled().drop("central"), n_lists)
        mixed = members.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("value")
        members = scratch.put(members.join(mixed, "value"), n_lists)
        bounds = scratch.put(_bounds(members, full, classes, percent), n_lists)
        members = scratch.put(members.join(bounds, "cls"), n_lists)
        chosen = scratch.put(lists.join(bounds, "cls", "left_semi").groupBy("cls").agg(F.collect_list("value").alias("values")).join(classes.select("cls", "sketch"), "cls").select(
            "cls", "sketch", F.expr("aggregate(transform(sketch, (x, i) -> if(array_contains(values, x), shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)").alias("prefix")))
        blocks = scratch.put(_dealt(members, scratch, percent))
        near = scratch.put(blocks.join(chosen, "cls").repartition("value", "x", "y").sortWithinPartitions("value", "x", "y")
                           .mapInPandas(lambda it: _candidates(it, size, percent), "a binary, b binary, crowd boolean, value long, x long, y long"))
        found = confirmed(near.filter("not crowd").select("a", "b"))
        crowds = near.filter("crowd").select("value", "x", "y")
        if not crowds.isEmpty():
            whole = blocks.join(crowds, ["value", "x", "y"]).join(chosen, "cls").hint("merge").join(full, "cls")
            found = found.unionAll(scratch.put(whole.repartition("value", "x", "y").sortWithinPartitions("value", "x", "y").mapInPandas(
                lambda it: _by_block(it, lambda block: _links_in_block(block, size, percent), ["a", "b"]), "a binary, b binary")))
        if not found.isEmpty():
            links = links.unionAll(found)
            roots = scratch.put(components(links, scratch), 2 * links.count())

    named = classes.select("cls", "doc_id", "text_key").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", "text_key", F.coalesce("root", "cls").alias("comp"))
    lowest = scratch.put(named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("low")))
    answers = scratch.put(named.join(lowest, "comp").select("cls", F.col("low.doc_id").alias("component_id"), F.col("low.text_key").alias("first_key")))
    alone = F.col("cls").isNull()
    return sketched.join(answers, "cls", "left").select(
        F.col("doc_id").alias(key), "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))).alias("first"))


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = 75, size: int = SKETCH, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) by :func:`grouped`: kept says that component_id is the row's own id."""
    return grouped(docs, scratch, width, percent, size, key, text).select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))
