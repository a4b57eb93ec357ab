"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

All sets share one order of shingles: frequent ones last, the others by hash. Two sets
of sizes m and n with similarity t share at least ceil(t·n) shingles, so their first
n - ceil(t·n) + k shingles share at least k. Each document picks its own k: a longer
prefix costs more index entries, but a partner must then share k of them, which
spares verifications. A pair is verified if it shares min(k, k') prefix shingles.

Only connected components are asked for, so a large group of copies is linked through
one of its documents first, and afterwards only pairs across different components
are looked at. Equal sets are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import mix, release, rows, sequence_hashes
from quillstack.llm.components import components
from quillstack.session import materialise

WIDTH = 4
CHOICES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32])
#: What verifying one shingle of a candidate costs, in index entries; meeting a
#: document once costs as much as one entry.
VERIFY_COST = 0.02
#: The six characters between words, and the masks of the lowest bytes of eight.
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of several texts, A-Z in lower case, and the number of
    words up to the end of each text. Words are read eight bytes at a time, all at once;
    the few longer than LONG_WORD bytes one by one."""
    data = b"\n" + b"\n".join([t or b"" for t in texts]).lower() + b"\n" * 9
    space = SPACES[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        value = mix((eight[start] & LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        row = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at, left = start[row] + 8, size[row] - 8
        while len(row):
            value[row] = mix(value[row] * np.uint64(0xD6E8FEB86659FD93) + (eight[at] & LOW_BYTES[np.minimum(left, 8)]))
            more = left > 8
            row, at, left = row[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[start[i]: start[i] + size[i]])
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
    return value, np.searchsorted(start, ends)


def shingles(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; a shorter text is one
    shingle. Runs of words over the end of a text are left out."""
    values, ends = word_hashes(texts)
    runs = sequence_hashes(values, width)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= width:
            own = runs[start: end - width + 1]
            own.sort()
            first = own[1:] != own[:-1]
            out.append(own if first.all() else own[np.concatenate([[True], first])])
        elif end > start:
            out.append(sequence_hashes(values[start:end], end - start, seed=end - start))
        else:
            out.append(runs[:0])
        start = end
    return out


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return shingles(batch.column("text").cast(pa.binary()).to_pylist(), width)


def needed(n, percent: int):
    """Shingles that a set of ``n`` shares at least with any similar set."""
    return (percent * n + 99) // 100


def ordered(tokens: np.ndarray, hot: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in the common order, and how frequent each is (power of two)."""
    level = np.zeros(len(tokens), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens.astype(np.uint32)), len(hot) - 1)
        level = np.where(hot[at] == tokens.astype(np.uint32), levels[at], 0)
    order = np.argsort(level, kind="stable")
    return tokens[order], level[order]


def head(tokens: np.ndarray, length: int, hot: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``length`` of the tokens in the common order. Tokens come by hash, so
    where enough of the first ones are not frequent the rest need not be looked up."""
    token, level = ordered(tokens[: 2 * length], hot, levels)
    if 2 * length < len(tokens) and level[length - 1]:
        token, level = ordered(tokens, hot, levels)
    return token[:length], level[:length]


def choose(level: np.ndarray, n: int, percent: int, background: float) -> int:
    """The number of prefix tokens to share that makes index entries plus expected
    verifications cheapest. The documents met through the first p tokens are at most
    the sum of their frequencies over the number that must be shared."""
    need = int(needed(n, percent))
    k = CHOICES[CHOICES <= need]
    length = n - need + k
    met = np.cumsum((1 << level.astype(np.int64)) - 1 + background)
    cost = length + met[length - 1] + VERIFY_COST * n * met[length - 1] / k
    return int(k[np.argmin(cost)])


def sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(id, n, digest, low)``: size and digest of each document's set, and the low
    halves of its prefix by hash order."""
    def run(batches):
        for part in rows(batches):
            found = shingle_sets(part, width)
            low = [s[: len(s) - int(needed(len(s), percent)) + 1].astype(np.uint32).tobytes() if len(s) else None
                   for s in found]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array([len(s) for s in found], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                pa.array(low, pa.binary()),
            ], ["id", "n", "digest", "low"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, n long, digest binary, low binary")


def _top(counted: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    top = counted.filter("n >= 4").orderBy(F.desc("n"), "token").limit(size).toPandas()
    return top["token"].to_numpy(np.int32).view(np.uint32), top["n"].to_numpy(np.float64)


def _table(token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens, each with the power of two of its largest count."""
    order = np.lexsort((-n, token))
    token, first = np.unique(token[order], return_index=True)
    return token, np.floor(np.log2(np.maximum(n[order][first], 1))).astype(np.int64)


def frequent(members: DataFrame, docs: DataFrame, width: int, percent: int,
             size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequent tokens (their low halves) with the power of two of their counts, and the
    mean excess over one of all counts. They only steer the order: any table gives the
    same result.

    The ``size`` most frequent tokens of the prefixes by hash order come first. Putting
    them last would bring up the other tokens of the same texts, so documents of which
    a fourth of that prefix is frequent have all their tokens counted, and again the
    ``size`` most frequent are taken."""
    def count(batches):
        for part in rows(batches, "low"):
            low = [np.frombuffer(x, np.uint32) for x in part.column("low").to_pylist() if x]
            token, n = np.unique(np.concatenate(low) if low else np.empty(0, np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int32)), pa.array(n)], ["token", "n"])

    counted = members.select("low").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = materialise(counted.filter("n > 1"), "shingle-counts")
    token, n = _top(counted, size)
    total, kinds = counted.agg(F.sum("n"), F.count("*")).first()
    background = min(1.0, ((total or 0) - (kinds or 0)) / max(1, (total or 0) + (kinds or 0)))
    shared = docs.sparkSession.sparkContext.broadcast(_table(token, n))

    def count_all(batches):
        for part in rows(batches):
            chosen = []
            for own in shingle_sets(part, width):
                first = own[: len(own) - int(needed(len(own), percent)) + 1]
                _, level = ordered(first, *shared.value)
                if len(own) and 4 * int((level >= 4).sum()) >= len(first):
                    chosen.append(own.astype(np.uint32))
            found, n = np.unique(np.concatenate(chosen) if chosen else np.empty(0, np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int32)), pa.array(n)], ["token", "n"])

    more = docs.select("text").mapInArrow(count_all, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    token2, n2 = _top(more, size)
    return *_table(np.concatenate([token, token2]), np.concatenate([n, n2])), max(background, 0.05)


def prefixes(docs: DataFrame, width: int, percent: int, table) -> DataFrame:
    """``(id, digest, n, k, weight, tokens)``: the prefix of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        hot, levels, background = shared.value
        for part in rows(batches):
            out = []
            for at, own in enumerate(shingle_sets(part, width)):
                n = len(own)
                if not n:
                    continue
                spare = n - int(needed(n, percent))
                token, level = head(own, min(n, spare + int(CHOICES[-1])), hot, levels)
                k = choose(level, n, percent, background)
                stop = spare + k
                out.append((at, xxhash.xxh3_128_digest(own.tobytes()), n, k, int(level[:stop].sum()),
                            token[:stop].tobytes()))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.binary()),
                 *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.binary())],
                ["id", "digest", "n", "k", "weight", "tokens"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, digest binary, n long, k long, weight long, tokens binary")


def entries(prefix: DataFrame) -> DataFrame:
    """``(token, id, place)`` for each token of each prefix."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                tokens = part.column("tokens").to_pylist()
                size = [len(t) // 8 for t in tokens]
                owner = np.repeat(np.arange(len(tokens)), size)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(tokens), np.int64)), part.column("id").take(pa.array(owner)),
                     pa.array(place.astype(np.int32))], ["token", "id", "place"])

    kind = dict(prefix.dtypes)["id"]
    return prefix.select("id", "tokens").mapInArrow(run, f"token long, id {kind}, place int")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar."""
    kind = dict(docs.dtypes)["id"]
    involved = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "involved")

    def build(batches):
        for part in rows(batches):
            found = shingle_sets(part, width)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "tokens"])

    whole = materialise(docs.join(involved, "id", "left_semi").mapInArrow(build, f"id {kind}, tokens binary"), "sets")

    def compare(batches):
        for batch in rows(batches, "x"):
            keep = []
            for at, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                if same and 100 * same >= percent * (len(x) + len(y) - same):
                    keep.append(at)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = pairs.join(whole.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    return left.join(whole.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select(
        "a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}")


def multi_matched(pairs: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that share enough prefix tokens: min(k, k'), and so many that
    the rest of the longer remainder could make up what similarity needs."""
    kind = dict(prefix.dtypes)["id"]

    def compare(batches):
        for part in rows(batches, "at"):
            keep = []
            columns = [part.column(c).to_pylist() for c in ("an", "ak", "at", "bn", "bk", "bt")]
            for row, (an, ak, at, bn, bk, bt) in enumerate(zip(*columns)):
                shared = len(np.intersect1d(np.frombuffer(at, np.uint64), np.frombuffer(bt, np.uint64), True))
                left = max(an - len(at) // 8, bn - len(bt) // 8)
                if shared >= min(ak, bk) and shared + left >= -(-percent * (an + bn) // (100 + percent)):
                    keep.append(row)
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def side(name: str) -> DataFrame:
        return prefix.select(F.col("id").alias(name), *(F.col(c).alias(name + c[0]) for c in ("n", "k", "tokens")))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "an", "ak", "at", "bn", "bk", "bt").mapInArrow(compare, f"a {kind}, b {kind}")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
         width: int = WIDTH, hot: int = 200_000) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row of ``docs``.

    Texts link when the Jaccard similarity of their sets of ``width``-word shingles
    (ASCII letters in lower case) is ``percent`` or more; equal sets always do. The
    component is the smallest id that links lead to. A null, empty or wordless text has
    no shingle and its own id. Rows of one id are judged each by its own text. Rows
    without an id get the component of an equal text that has one, null if there is none:
    they link nothing. Give rows a key of their own where ids are missing.
    Twice ``hot`` bounds the table of frequent shingles that every task gets."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members = materialise(sets(docs, width, percent), "shingle-sets")
    classes = materialise(
        members.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "shingle-classes")
    table = frequent(members, docs, width, percent, hot)
    release(spark)
    reps = classes.select("digest", F.col("rep").alias("id")).filter("id IS NOT NULL")
    prefix = materialise(prefixes(docs, width, percent, table).join(reps, ["id", "digest"], "left_semi"), "prefixes")
    release(spark)
    about = prefix.select("id", "n", "k", "weight")
    listed = entries(prefix)
    common = listed.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    shared = materialise(listed.join(common, "token"), "shared-tokens")
    release(spark)

    # A pair of sizes m and n shares at least ``needs`` tokens, and from its first shared
    # token on both have that many left. Pairs without such a token are never formed.
    c = F.col

    def possible(one: str, two: str):
        both = c(f"{one}_n") + c(f"{two}_n")
        needs = F.ceil(percent * both / (100 + percent) - 1e-9)
        sizes = 100 * F.least(f"{one}_n", f"{two}_n") >= percent * F.greatest(f"{one}_n", f"{two}_n")
        return sizes, F.least(c(f"{one}_n") - c(f"{one}_place"), c(f"{two}_n") - c(f"{two}_place")) >= needs

    def named_as(frame: DataFrame, name: str, *columns: str) -> DataFrame:
        return frame.select(c("token").alias(f"{name}_token"), *(c(x).alias(f"{name}_{x}") for x in columns))

    # First the pairs with the most central document of each token's list: the one
    # whose own prefix is the most frequent, so the least altered of its group.
    fields = ("id", "place", "n", "k")
    detailed = materialise(shared.join(about, "id"), "shared-details")
    rank = F.struct("weight", F.xxhash64("id").alias("h"))
    centre = detailed.groupBy("token").agg(F.max_by(F.struct(*fields), rank).alias("c")).select("token", "c.*")
    sizes, bound = possible("x", "y")
    star = named_as(detailed, "x", *fields).join(named_as(centre, "y", *fields), c("x_token") == c("y_token"))
    star = star.filter((c("x_id") != c("y_id")) & sizes).groupBy(
        F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.least("x_k", "y_k").alias("k")
    ).agg(F.count("*").alias("shared"), F.max(bound).alias("possible")).filter("possible AND shared >= k")
    tried = materialise(star.select("a", "b").distinct(), "star-pairs")
    links = materialise(verified(tried, docs, width, percent), "star-links")
    release(spark)

    # Then every pair across components.
    found = components(links).withColumnRenamed("node", "id")
    named = materialise(
        detailed.join(found, "id", "left").withColumn("comp", F.coalesce("component", "id")), "shared-components")
    split = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    mixed = materialise(named.join(split.select("token"), "token"), "mixed-tokens")
    fields = ("id", "place", "n", "comp")
    sizes, bound = possible("a", "b")
    met = named_as(mixed, "a", *fields).join(
        named_as(mixed, "b", *fields),
        (c("a_token") == c("b_token")) & (c("a_id") < c("b_id")) & (c("a_comp") != c("b_comp")) & sizes & bound)
    rest = materialise(met.select(c("a_id").alias("a"), c("b_id").alias("b")).distinct(), "met-pairs")
    rest = multi_matched(rest.join(tried, ["a", "b"], "left_anti"), prefix, percent)
    rest = materialise(rest, "rest-pairs")
    more = materialise(verified(rest, docs, width, percent), "rest-links")
    release(spark)
    found = components(links.unionByName(more)).select(c("node").alias("rep"), "component")
    resolved = materialise(classes.join(found, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")), "class-components")
    return members.join(resolved, "digest", "left").select(
        c("id").alias(id_col), c("n").alias("n_shingles"),
        F.when(c("n") > 0, c("component")).otherwise(c("id")).alias("component_id"))
