"""Line dedup: a segment-partition edit join over distinct lines.

A line of length L is split into threshold + 1 segments. If two lines are within the threshold,
one segment of the shorter stands unchanged in the longer, close to its own place; so each line
probes an index of (length, segment number, segment) with the few substrings that can be it.

A line goes if any earlier one is near, so one witness a line is enough and pairs are never laid
out. In a bucket of the index all lines meet two of those filed there. Buckets with more go on in
rounds: lines without a witness yet meet samples of the bucket's lines that grow sixteenfold, up to the
whole bucket, and leave as soon as they have one. Candidates pass a letter-count bound and then a
banded, bit-parallel edit distance folded by ``aggregate``. Only DataFrame functions.

Lines under MIN_CHARS characters are not joined by edits: of those, exact repeats go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._session import cut

MAX_EDITS = 2
#: Of shorter lines only exact repeats go: within two edits they would meet unrelated lines.
MIN_CHARS = 24
#: What is broadcast at most, by the sizes of its rows; more is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: The letters commonest in English, counted modulo eight, three bits each.
LETTERS = "etaoinshrdlcumw"
#: Lines that occur so often are laid out once only, or so often that the list of them is within BROADCAST_BYTES.
HOT_TIMES = 1000
HOT_BYTES = 48
#: Lines of a crowded bucket that the others meet in the first round, and the growth from round to round.
FIRST_SAMPLE, GROWTH = 16, 16


def _segments(length: str, parts: int):
    """(start, size) of each part, 0-based, for an integer expression; the last ones are one longer where it doesn't divide."""
    base, rest = F.expr(f"({length}) div {parts}").cast("int"), F.expr(f"({length}) % {parts}").cast("int")
    for i in range(parts):
        yield base * i + F.greatest(F.lit(0), rest - (parts - i)), base + F.when(rest >= parts - i, 1).otherwise(0)


def _keys(max_edits: int) -> Column:
    """Keys of a line of length ``n``: its own segments (filed) and substrings that could be a segment of an equally long or shorter line.

    A key is a hash of length, part and characters; ``wide`` has four bytes each, so no character is searched for.
    """
    rows, parts = [], max_edits + 1
    for less in range(max_edits + 1):
        for i, (start, size) in enumerate(_segments(f"n - {less}", parts)):
            # Left of part i at most i edits, right of it at most max_edits - i (multi-match-aware).
            for shift in range(-max_edits, max_edits + 1):
                if abs(shift) <= i and abs(less - shift) <= max_edits - i:
                    characters = F.substring(F.col("wide"), (start + shift) * 4 + 1, size * 4)
                    key = F.xxhash64(F.expr(f"n - {less}"), F.lit(i), characters)
                    rows.append(F.struct(key.alias("key"), F.lit(not less and not shift).alias("filed")))
    return F.array(*rows)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.trim(F.col("line")).alias("line")).where(F.length("line") >= min_chars)


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b")]


def _sketch(line: Column) -> Column:
    """Counts of some letters, modulo eight."""
    total = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        total = total.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(7)).cast("long"), 3 * i))
    return total


def _close(x: Column, y: Column, max_edits: int) -> Column:
    """An edit changes at most two counts by one each; modulo eight, counts are no farther apart than they are."""
    gap, seven = F.lit(0).cast("long"), F.lit(7).cast("long")
    for i in range(len(LETTERS)):
        apart = (F.shiftright(x, 3 * i) - F.shiftright(y, 3 * i)).bitwiseAND(seven)
        gap = gap + F.least(apart, F.lit(8) - apart)
    return gap <= 2 * max_edits


def within(one: str, two: str, max_edits: int) -> Column:
    """Whether two string columns are within ``max_edits`` (at most 4) by a banded bit-parallel edit distance.

    Lane d of a BIGINT has a bit for each of 2k + 1 diagonals: whether it is reached with d edits. A step
    over a character of ``one`` moves all lanes at once. What both begin and end with is skipped first.
    """
    if not 0 <= max_edits <= 4:
        raise ValueError("a BIGINT holds the lanes of at most 4 edits")
    k, w = max_edits, 2 * max_edits + 1
    lanes = [((1 << w) - 1) << (w * d) for d in range(k + 1)]
    every, ones = sum(lanes), sum(1 << (w * d) for d in range(k + 1))
    no_top = every & ~sum(1 << (w * d + w - 1) for d in range(k + 1))
    start = sum(1 << (w * d + k + e) for d in range(k + 1) for e in range(d + 1))

    # Steps of halved size find how many characters are common; 2**20 is more than a longest line needs to be exact.
    sizes = "array(" + ", ".join(str(1 << e) for e in range(20, -1, -1)) + ")"
    common = "aggregate({s}, 0, (p, z) -> if(p + z <= {m} and {left} = {right}, p + z, p))"
    head = common.format(s=sizes, m=f"least(length({one}), length({two}))", left=f"substring({one}, p + 1, z)", right=f"substring({two}, p + 1, z)")
    tail = common.format(s=sizes, m=f"least(length({one}), length({two})) - h", left=f"substring({one}, length({one}) - p - z + 1, z)", right=f"substring({two}, length({two}) - p - z + 1, z)")
    # The lambda variables h, t, x, y, v are bound by transforms of one element.
    wide = "encode(substring({c}, h + 1, length({c}) - h - t), 'UTF-32')"
    pad = f"X'{'FFFFFFFF' * k}'"
    x, y = wide.format(c=one), f"concat({pad}, {wide.format(c=two)})" if k else wide.format(c=two)
    same = " + ".join(f"if(substring(y, (i + {b}) * 4 + 1, 4) = substring(x, i * 4 + 1, 4), {1 << b}L, 0L)" for b in range(w))
    moved = f"((r & ({same}) * {ones}L) | shiftleft(r | (shiftright(r, 1) & {no_top}L), {w})) & {every}L"
    grown = " | ".join(["v"] + [f"(shiftleft(v, {(w + 1) * e}) & {sum(((1 << w) - (1 << e)) << (w * d) for d in range(e, k + 1))}L)" for e in range(1, k + 1)])
    step = f"transform(array({moved}), v -> {grown})[0]"
    ends = f"length({two}) - length({one}) + {k}"
    fold = f"aggregate(sequence(1, length({one}) - h - t), {start}L, (r, j) -> transform(array(j - 1), i -> {step})[0])"
    done = f"shiftright({{r}}, {w * k} + {ends}) & 1"
    inner = f"if(length({one}) = h + t, {done.format(r=f'{start}L')}, transform(array({x}), x -> transform(array({y}), y -> {done.format(r=fold)})[0])[0]) = 1"
    test = f"transform(array({head}), h -> transform(array({tail}), t -> {inner})[0])[0]"
    return F.expr(f"if(abs(length({one}) - length({two})) > {k}, false, {test})")


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Broadcast if its rows have BROADCAST_BYTES at most; else it is joined by a shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def near_lines(docs: DataFrame, firsts: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b): identities of the lines that have a different earlier line within ``max_edits``.

    ``firsts``: (a, b, first, times) of every line, from the same documents; ``first`` orders lines.
    """
    if min_chars < (max_edits + 1) ** 2:
        raise ValueError("lines are too short for so many edits")
    lines, line = _lines(docs, id_col, text_col, min_chars), F.col("line")
    # At most total / least lines occur ``least`` times, which bounds what is broadcast.
    least = max(HOT_TIMES, (firsts.agg(F.sum("times")).first()[0] or 0) * HOT_BYTES // BROADCAST_BYTES + 1)
    hot = firsts.where(F.col("times") >= least).select("a", "b", "first")
    once = lines.select("doc_id", "line_no", "line", *_identity(line)).join(F.broadcast(hot), ["a", "b"], "left")
    once = once.where(F.col("first").isNull() | (F.col("first") == F.struct("doc_id", "line_no")))
    narrow = once.select("a", F.length(line).alias("n"), F.encode(line, "UTF-32").alias("wide"))
    keyed = narrow.select("a", F.inline(_keys(max_edits))).repartition("key")

    # Two of the lines filed in each bucket, and how many rows it has; both sides read one exchange, for
    # a filter on a row number is not pushed below it.
    filed = keyed.where(F.when(F.monotonically_increasing_id() >= 0, F.col("filed")))
    filed = filed.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count(F.lit(1)).alias("n"))
    met = cut(keyed.join(filed.hint("merge"), "key").where("low <> high or low <> a"))
    either = met.select("a", F.explode(F.array_distinct(F.array("low", "high"))).alias("c")).where("a <> c")
    pairs = either.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c")).distinct()
    crowded = met.where("n > 2 and low <> high").groupBy("key", "a").agg(F.max("filed").alias("filed"))
    pairs, crowded = cut(pairs), cut(crowded)

    wanted = cut(pairs.select("a").union(pairs.select("c")).union(crowded.select("a")).distinct())
    texts = lines.select(*_identity(line), "line").join(_small(wanted, F.lit(16)), "a", "left_semi")
    texts = texts.groupBy("a", "b").agg(F.first("line").alias("line")).join(firsts.select("a", "b", "first"), ["a", "b"])
    texts = cut(texts.withColumn("sketch", _sketch(line)))

    def later(candidates: DataFrame) -> DataFrame:
        """Of each candidate pair (a, c) within ``max_edits`` the line that comes later."""
        left = texts.select("a", "b", F.col("line").alias("one"), "first", "sketch")
        right = texts.toDF("c", "d", "two", "other", "sketch_c")
        both = candidates.join(left, "a").join(right, "c").where(_close(F.col("sketch"), F.col("sketch_c"), max_edits))
        near = both.where(within("one", "two", max_edits))
        mine = F.col("first") > F.col("other")
        return near.select(F.when(mine, F.col("a")).otherwise(F.col("c")).alias("a"), F.when(mine, F.col("b")).otherwise(F.col("d")).alias("b")).distinct()

    decided = cut(later(pairs))
    sizes = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    most = sizes.agg(F.max("m")).first()[0] or 0
    if not most:
        return decided
    members = cut(crowded.join(sizes, "key").join(texts.select("a", "b", "first", "sketch"), "a"))
    draw = F.shiftrightunsigned(F.xxhash64("a", F.lit("draw")), 12) / F.lit(float(1 << 52)) * F.col("m")
    members = members.withColumn("draw", draw)
    low, high = 0, FIRST_SAMPLE
    while True:
        # A crowded bucket can be skewed; both sides are dealt by the join itself, so Spark splits it.
        u = members.join(decided, ["a", "b"], "left_anti").drop("draw", "m").alias("u")
        v = members.where((F.col("draw") >= low) & ((F.col("draw") < high) | F.lit(high >= most))).drop("draw", "m").alias("v")
        on = F.expr("u.key = v.key and u.a <> v.a and v.first < u.first and (u.filed or v.filed)")
        found = u.join(v, on & _close(F.col("u.sketch"), F.col("v.sketch"), max_edits)).select(F.col("u.a").alias("a"), F.col("v.a").alias("c")).distinct()
        decided = cut(decided.union(later(cut(found))).distinct())
        if high >= most:
            return decided
        low, high = high, high * GROWTH


def line_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, near: bool = True, short: bool = False) -> DataFrame:
    """(doc_id, line_no) of the lines to remove, 0-based.

    ``near``: a line of at least ``min_chars`` characters is removed if an earlier one of them, by
    (doc_id, line_no), is within ``max_edits`` of it. ``short``: a shorter line is removed if an
    earlier one is equal, unless it is blank, of white space alone.
    Lines are compared as they are in the input, without spaces at their ends.
    """
    line, long = F.col("line"), F.length("line") >= min_chars
    lines = _lines(docs, id_col, text_col, 1 if short else min_chars).where(F.col("doc_id").isNotNull())
    if short:
        lines = lines.where((long & F.lit(near)) | (~long & line.rlike(r"\S")))
    place = F.struct("doc_id", "line_no")
    occurrences = cut(lines.select("doc_id", "line_no", *_identity(line), long.alias("is_long")))
    firsts = cut(occurrences.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), F.first("is_long").alias("is_long")))
    limits = firsts.where("times > 1").select("a", "b", "first", F.lit(False).alias("all"))
    if near:
        later = near_lines(docs.where(F.col(id_col).isNotNull()), firsts.where("is_long"), id_col, text_col, max_edits, min_chars)
        limits = limits.join(later, ["a", "b"], "left_anti").union(later.select("a", "b", F.lit(None).alias("first"), F.lit(True).alias("all")))
    return occurrences.join(limits, ["a", "b"]).where(F.col("all") | (place > F.col("first"))).select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, near: bool = True, short: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines and n_removed beside it.

    ``near`` and ``short``: as in ``line_removals``; by default near duplicates of long lines and
    exact repeats of shorter ones go.
    Lines are what ``\\n`` separates. Null text stays null with 0 lines; empty text is one line, kept,
    as are blank lines. Rows with a null id keep all. Rows that repeat an id
    share its removals. Columns n_lines and n_removed of ``docs`` are replaced; the others stay.
    """
    gone = line_removals(docs, id_col, text_col, max_edits, min_chars, near, short).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_id")
    gone = _small(cut(gone), F.size("_gone") * 4 + 32)
    joined = docs.drop("n_lines", "n_removed").join(gone, F.col(id_col) == F.col("_id"), "left")
    lines = F.split(F.col(text_col), "\n")
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return joined.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines), "n_removed": F.coalesce(F.size("_gone"), F.lit(0))}).withColumn(text_col, text).drop("_gone", "_id")
