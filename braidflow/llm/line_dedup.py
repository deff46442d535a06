"""Line dedup: a suffix array over line-ID sequences, by DataFrame operations alone.

A line's ID is the 64-bit hash of the line without white space at its ends; blank lines are left out, so
that runs pass over them. A suffix is what follows from a line to its document's end; those from lines that occur
once share nothing and are left out. A suffix's rank at depth 1 is the place that the first suffix with its first
line has among all, by the lines' IDs. A doubling round pairs a suffix's rank with that of the suffix k lines further
on in the same document; the place of the first suffix with the same pair is the rank at depth 2k. Rounds go on until
no rank repeats, whatever min_lines is: then the ranks are the suffix array. A document whose ranks are all unique
leaves the rounds, so that a round costs what still repeats.

Neighbours in the array had one rank up to the last depth at which the later one's changed. From there on the ranks at
half that depth, a quarter and so on, of what follows the lines that they are known to share, give the common prefix to the
line (_common_prefixes). What a suffix shares with any other is the least of the prefixes between them, so the most that
it shares with one that begins earlier (by doc_id, then position) comes from the neighbours' prefixes alone (_earlier). That is its
maximal run that is a later copy (repeated_runs). Those of min_lines lines and more are deleted, by their characters:
with whole, min_chars holds for a run's total; else for each window of min_lines lines in it. The pipeline asks for whole
runs; op4_line_dedup is held to its SQL, which counts by windows.

Pairs are combined before they are numbered and dealt out by ranges, the joins back to suffixes are ones whose large
partitions Spark splits, and the array is taken by ranges of places, so a run that a third of all documents hold is no
task's alone. Runs that overlap are made one before their lines are listed, so a line is listed once.

Defined cases: a null text counts as empty and stays empty; null doc_ids come first; rows that are equal
in doc_id and text are one document and lose the same lines; copies within a document count, and where
they overlap every line that lies in a later copy goes; windows of min_lines lines (with whole, runs) under
min_chars characters stay; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidflow.llm.common import Scratch, fresh, release, table

MIN_LINES = 2
MIN_CHARS = 32
BLANKS = " \t\r\x0b\x0c"
#: Places of the suffix array that a range has at first, and by what later ranges are wider.
RANGE = 512
WIDER = 32


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _place() -> Column:
    return F.struct("doc_id", "pos")


def _numbered(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """pairs: rank, beyond, size -> this, that, next_size, next_rank: the places in sorted order of the first suffix of each pair, from that of the first with the same rank."""
    before = W.partitionBy("part", "rank").orderBy("beyond").rowsBetween(W.unboundedPreceding, -1)
    dealt = pairs.repartitionByRange("rank", "beyond").withColumn("part", F.spark_partition_id())
    counted = scratch.write(dealt.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))), name)
    # a rank that goes on from one range of pairs to the next; a row for each range comes to the driver
    ends = counted.groupBy("part").agg(F.min("rank"), F.max(F.struct("rank", (F.col("before") + F.col("size")).alias("upto")))).collect()
    firsts, carries, going, upto = [-1], [0], -1, 0
    for part, first, last in sorted(ends):
        gap = part + 1 - len(firsts)
        firsts, carries = [*firsts, *[-1] * gap, first], [*carries, *[0] * gap, upto if first == going else 0]
        going, upto = last["rank"], last["upto"] + (carries[-1] if first == last["rank"] else 0)
    here = F.col("part") + 1
    carried = F.when(F.get(F.array(*map(F.lit, firsts)), here) == F.col("rank"), F.get(F.array(*map(F.lit, carries)), here)).otherwise(0)
    return counted.select(F.col("rank").alias("this"), F.col("beyond").alias("that"), F.col("size").alias("next_size"), (F.col("rank") + F.col("before") + carried).alias("next_rank"))


def _doubled(suffixes: DataFrame, scratch: Scratch, depth: int) -> tuple[DataFrame, bool]:
    """suffixes: nr, rk, doc_id, pos, head, chars, rank, size, apart, common at a depth -> these at twice it, and left (whether the rank has just become theirs alone); whether any rank repeats."""
    document = W.partitionBy("rk", "doc_id")
    own = document.orderBy("pos").rangeBetween(depth, depth)
    paired = suffixes.withColumn("beyond", F.coalesce(F.first("rank").over(own), -1 - F.col("nr"))).withColumn("more", F.first("chars").over(own))
    paired = scratch.write(paired.withColumn("most", F.max("size").over(document)).where("most > 1").drop("most", "left"), f"pairs-{2 * depth}")
    again = paired.where("size > 1")
    ranks = _numbered(again.groupBy("rank", "beyond").agg(F.count("*").alias("size")), scratch, f"ranks-{2 * depth}")
    joined = again.join(ranks, (F.col("rank") == F.col("this")) & (F.col("beyond") == F.col("that")))
    parted = F.col("next_rank") != F.col("rank")  # from the one before
    grown = F.when(F.col("next_size") > 1, F.col("chars") + F.col("more")).otherwise(F.col("chars"))
    apart, common = F.when(parted, F.lit(depth)).otherwise(F.col("apart")), F.when(parted, F.col("chars")).otherwise(F.col("common"))
    joined = joined.select("nr", "rk", "doc_id", "pos", "head", grown.alias("chars"), F.col("next_rank").alias("rank"), F.col("next_size").alias("size"), apart.alias("apart"), common.alias("common"), (F.col("next_size") == 1).alias("left"))
    rest = paired.where("size = 1").select(*joined.columns[:-1], F.lit(False).alias("left"))
    split = scratch.write(joined.unionByName(rest), f"depth-{2 * depth}")
    scratch.drop(f"pairs-{2 * depth}", f"ranks-{2 * depth}")
    return split, not split.where("size > 1").isEmpty()


def _lengthened(near: DataFrame, level: DataFrame, scratch: Scratch, step: int) -> DataFrame:
    """near: suffixes, those before them (of, of_id, from) and n lines that both begin with -> n is step more where what follows has one rank at that depth."""
    level = level.where("size > 1")
    for side, (rk, doc_id, pos) in {"a": ("rk", "doc_id", "pos"), "b": ("of", "of_id", "from")}.items():
        names = [f"{side}_{c}" for c in ("rk", "id", "pos", "rank", "chars")]
        there = level.select(*(F.col(c).alias(x) for c, x in zip(("rk", "doc_id", "pos", "rank", "chars"), names)))
        same = (F.col(rk) == F.col(names[0])) & F.col(doc_id).eqNullSafe(F.col(names[1])) & (F.col(pos) + F.col("n") == F.col(names[2]))
        near = near.join(there.hint("merge"), same, "left").drop(*names[:3])
    more = F.col("a_rank") == F.col("b_rank")
    near = near.withColumn("chars", F.when(more, F.col("chars") + F.col("a_chars")).otherwise(F.col("chars"))).withColumn("n", F.when(more, F.col("n") + F.lit(step)).otherwise(F.col("n")))
    near = scratch.write(near.drop("a_rank", "a_chars", "b_rank", "b_chars"), f"near-{step}")
    scratch.drop(f"near-{2 * step}")
    return near


def _common_prefixes(array: DataFrame, levels: dict[int, DataFrame], scratch: Scratch, min_lines: int) -> DataFrame:
    """array: at, rk, doc_id, pos, head, apart, common -> at, n, chars: the lines that a suffix and the one before it in the array both begin with, min_lines or more, and their characters."""
    last = array.select((F.col("at") + 1).alias("next"), F.col("rk").alias("of"), F.col("doc_id").alias("of_id"), F.col("pos").alias("from"))
    pairs = array.where(F.col("apart") * 2 > min_lines).join(last, F.col("at") == F.col("next"))
    pairs = scratch.write(pairs.select("at", "rk", "doc_id", "pos", "of", "of_id", "from", "apart", F.col("apart").alias("n"), F.col("common").alias("chars")), "neighbours")
    near = pairs.where("false").drop("apart")
    for depth in sorted(levels, reverse=True):
        if 2 * depth < max(levels):
            near = _lengthened(near, levels[depth], scratch, depth)
        near = near.unionByName(pairs.where(F.col("apart") == depth).drop("apart"))
    near = scratch.write(near.where(F.col("n") >= min_lines).select("at", "n", "chars"), "prefixes")
    release(near.sparkSession)
    return near


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _run(link: Column, x: Column) -> Column:
    return F.struct(link["n"].alias("n"), link["chars"].alias("chars"), x["members"].alias("members"))


def _entry(x: Column, link: Column, members: Column) -> Column:
    return F.struct(x["at"].alias("at"), x["place"].alias("place"), link["n"].alias("n"), link["chars"].alias("chars"), members.alias("members"))


def _shut(state: Column, n: Column) -> Column:
    """The entries that share more with the one below them than the n lines that come next leave the stack, since that one begins earlier; those of the same place become one entry."""

    def leave(v: Column) -> Column:
        out, stack, low = v["out"], v["stack"], F.element_at(v["stack"], -1)
        begun = F.transform(F.filter(out, lambda x: x["place"] != low["place"]), lambda x: _run(F.get(F.filter(out, lambda y: y["place"] == x["place"]), 0), x))
        twins = F.filter(out, lambda x: x["place"] == low["place"])
        one = F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(_entry(low, low, F.concat(low["members"], F.flatten(F.transform(twins, lambda x: x["members"]))))))
        stack = F.when(F.size(twins) == 0, stack).otherwise(one)
        return F.struct(stack.alias("stack"), state["kept"].alias("kept"), F.concat(state["runs"], begun).alias("runs"))

    goes = F.filter(state["stack"], lambda x, i: (i > 0) & (x["n"] >= n))
    stays = F.filter(state["stack"], lambda x, i: (i == 0) | (x["n"] < n))
    return F.when(F.size(goes) == 0, state).otherwise(_let(F.struct(goes.alias("out"), stays.alias("stack")), leave))


def _taken(state: Column, x: Column) -> Column:
    """The state when the next entry x has come."""

    def bottom(v: Column) -> Column:
        low, last = F.get(v["stack"], 0), F.try_element_at(v["kept"], F.lit(-1))
        earlier = ((low["n"] == x["n"]) & (x["place"] < low["place"])) | F.coalesce(last["place"] < low["place"], F.lit(False))
        kept = F.when(earlier, v["kept"]).otherwise(F.concat(v["kept"], F.array(low)))
        runs = F.when(earlier, F.concat(v["runs"], F.array(_run(low, low)))).otherwise(v["runs"])
        return F.struct(F.array(x).alias("stack"), kept.alias("kept"), runs.alias("runs"))

    def top(v: Column) -> Column:
        def on(later: Column) -> Column:
            links = F.concat(F.slice(later, 2, F.greatest(F.size(later) - 1, F.lit(0))), F.array(x))
            runs = F.transform(later, lambda y, i: _run(F.get(links, i), y))
            link = F.when(F.size(later) > 0, F.get(later, 0)).otherwise(x)
            stack = F.concat(F.slice(v["stack"], 1, F.size(v["stack"]) - F.size(later)), F.array(_entry(x, link, x["members"])))
            return F.struct(stack.alias("stack"), v["kept"].alias("kept"), F.concat(v["runs"], runs).alias("runs"))

        return _let(F.filter(v["stack"], lambda y: y["place"] > x["place"]), on)

    return _let(_shut(state, x["n"]), lambda v: F.when((F.size(v["stack"]) == 1) & (F.get(v["stack"], 0)["n"] >= x["n"]), bottom(v)).otherwise(top(v)))


def _earlier(array: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """array and its neighbours' common prefixes -> rk, doc_id, pos, n, chars, head: the most that each suffix has in common with any that begins earlier.

    Of two neighbours that share no less with each other than with their other ones, the later leaves: it shares no more with any,
    and whatever shares n lines with it shares them with the earlier one too. Those that it stood between are neighbours then, by the
    lesser of its prefixes. What a range of the array can't decide without the next one is left to a wider range. Those share
    less at each step inward, so there are two at most for each length (more only where rows share a doc_id).
    """
    both = prefixes.select("at", "n", "chars", F.lit(0).alias("next")).unionByName(prefixes.select((F.col("at") - 1).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.col("n").alias("next")))
    links = both.groupBy(F.col("at").alias("of")).agg(F.max("n").alias("n"), F.max("chars").alias("chars"), F.max("next").alias("next"))
    members = F.array(F.struct("rk", "doc_id", "pos", "head"))
    rest = array.join(links, F.col("at") == F.col("of")).select("at", _place().alias("place"), "n", "chars", members.alias("members"), "next")
    out, width, k = None, RANGE, 0
    while k == 0 or not rest.isEmpty():
        entry = F.struct("at", "place", "n", "chars", "members")
        ranges = rest.groupBy(F.floor(F.col("at") / width).alias("range")).agg(F.sort_array(F.collect_list(entry)).alias("all"), F.max_by("next", "at").alias("next"))
        start = F.struct(F.slice("all", 1, 1).alias("stack"), F.slice("all", 1, 0).alias("kept"), F.transform(F.slice("all", 1, 0), lambda x: _run(x, x)).alias("runs"))
        state = F.aggregate(F.slice("all", 2, F.size("all")), start, _taken)
        done = ranges.select("next", state.alias("state")).select("next", _shut(F.col("state"), F.col("next")).alias("state"))
        done = done.select("next", F.concat("state.kept", "state.stack").alias("kept"), F.col("state.runs").alias("runs"))
        done = scratch.write(done, f"ranges-{k}")
        kept = done.select("next", "kept", F.posexplode("kept").alias("i", "x")).withColumn("next", F.coalesce(F.get("kept", F.col("i") + 1)["n"], F.col("next")))
        rest = kept.where("x.n > 0 OR next > 0").select("x.*", "next")
        runs = done.select(F.explode("runs").alias("x")).where("x.n > 0").select("x.n", "x.chars", F.explode("x.members").alias("m")).select("m.rk", "m.doc_id", "m.pos", "n", "chars", "m.head")
        out, width, k = runs if out is None else out.unionByName(runs), width * WIDER, k + 1
    return out


def suffix_array(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """docs: rk, doc_id, text -> the suffixes that another one may share min_lines lines with, by their place in the array: at, rk, doc_id, pos, head, apart, common; and of at those that share as many with the one before: at, n, chars."""
    filled = F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: F.length(x) > 0)
    lines = docs.select("rk", "doc_id", F.posexplode(filled).alias("pos", "line")).select("rk", "doc_id", "pos", F.xxhash64("line").alias("id"), F.length("line").cast("long").alias("chars"))
    ids = lines.groupBy(F.col("id").alias("beyond")).agg(F.count("*").alias("size")).where("size > 1").withColumn("rank", F.lit(0).cast("long"))
    ids = _numbered(ids, scratch, "ids").select(F.col("that").alias("id"), F.col("next_rank").alias("rank"), F.col("next_size").alias("size"))
    own = W.partitionBy("rk", "doc_id").orderBy("pos").rangeBetween(0, min_lines - 1)
    # rows that are equal in doc_id and text are one document
    suffixes = lines.join(ids, "id").dropDuplicates(["rk", "doc_id", "pos"]).withColumn("head", F.sum("chars").over(own)).withColumn("nr", F.monotonically_increasing_id())
    suffixes = suffixes.select("nr", "rk", "doc_id", "pos", "head", "chars", "rank", "size", F.lit(0).alias("apart"), F.lit(0).cast("long").alias("common"), F.lit(False).alias("left"))
    levels, depth, repeats = {1: scratch.write(suffixes, "depth-1")}, 1, True
    array = levels[1].where("false")
    while repeats:
        levels[2 * depth], repeats = _doubled(levels[depth], scratch, depth)
        depth *= 2
        if depth > min_lines:
            array = array.unionByName(levels[depth].where("left"))
    array = scratch.write(array.select(F.col("rank").alias("at"), "rk", "doc_id", "pos", "head", "apart", "common"), "array")
    release(docs.sparkSession)  # the rounds' plans and classes, which the driver would still hold
    return array, _common_prefixes(array, levels, scratch, min_lines)


def repeated_runs(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """docs: rk, doc_id, text -> rk, doc_id, pos, n, chars, head: the longest run from each line that has an earlier copy, of min_lines lines or more, its characters and those of its first min_lines lines."""
    return _earlier(*suffix_array(docs, scratch, min_lines), scratch)


def repeated_lines(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, whole: bool = False) -> DataFrame:
    """docs: rk, doc_id, text -> rk, doc_id, gone: the places among the lines with text of those that are later copies."""
    runs = repeated_runs(docs, scratch, min_lines)
    runs = runs.where(F.col("chars") >= min_chars) if whole else runs.where(F.col("head") >= min_chars).withColumn("n", F.lit(min_lines))
    before = W.partitionBy("rk", "doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n")
    runs = runs.withColumn("begin", F.greatest("pos", F.max(end).over(before))).where(F.col("begin") < end)
    lines = runs.select("rk", "doc_id", F.explode(F.sequence("begin", end - 1)).alias("pos"))
    return scratch.write(lines.groupBy("rk", "doc_id").agg(F.collect_list("pos").alias("gone")), "marked")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, whole: bool = False) -> DataFrame:
    """The rows of docs with text less its later copies, and n_lines, n_removed_lines (blank lines aside). whole: min_chars holds for runs."""
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rk = F.xxhash64(doc_id, text)
    key, mark, of, gone, parts, filled, n_lines, n_removed = fresh(docs.columns, "key", "mark", "of", "gone", "parts", "filled", "n_lines", "n_removed_lines")
    marked = repeated_lines(docs.select(rk.alias("rk"), doc_id.alias("doc_id"), text.alias("text")), scratch, min_lines, min_chars, whole).select(F.col("rk").alias(mark), F.col("doc_id").alias(of), F.col("gone").alias(gone))

    rows = docs.withColumn("text", text).withColumn(key, rk)
    # always by shuffle, so that the plan, and what it needs of disk, is the same at every size
    joined = rows.join(marked.hint("merge"), (F.col(key) == F.col(mark)) & doc_id.eqNullSafe(F.col(of)), "left")
    split = F.split("text", "\n")
    joined = joined.withColumn(parts, split).withColumn(filled, F.filter(F.transform(split, lambda x, i: F.when(F.length(_bare(x)) > 0, i)), lambda i: i.isNotNull()))
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.transform(gone, lambda p: F.get(F.col(filled), p)))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col(parts), i)), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    out = out.withColumn(n_lines, F.size(filled).cast("long")).withColumn(n_removed, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return out.select(*docs.columns, n_lines, n_removed)


def keep_rest(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their later copies, with the columns of docs; those with nothing else go."""
    out = line_dedup(docs, min_lines, min_chars, whole=True)
    n_lines, n_removed = (F.col(c) for c in out.columns[-2:])
    out = out.where((n_lines == 0) | (n_removed < n_lines))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT DISTINCT doc_id, text FROM docs),
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM d),
bare AS (SELECT doc_id, text, line, nth, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM split),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY nth) AS pos FROM bare WHERE length(bare) > 0),
pairs AS (SELECT doc_id, text, pos, bare AS a, lead(bare) OVER (PARTITION BY doc_id, text ORDER BY pos) AS b FROM filled),
runs AS (SELECT *, min({{'doc_id': doc_id, 'pos': pos}}) OVER (PARTITION BY a, b) AS first FROM pairs WHERE b IS NOT NULL AND length(a) + length(b) >= {MIN_CHARS}),
later AS (SELECT doc_id, text, pos FROM runs WHERE first <> {{'doc_id': doc_id, 'pos': pos}}),
gone AS (SELECT doc_id, text, pos FROM later UNION SELECT doc_id, text, pos + 1 FROM later),
marked AS (SELECT f.doc_id, f.text, f.nth FROM filled f JOIN gone g ON f.doc_id = g.doc_id AND f.text = g.text AND f.pos = g.pos),
rest AS (SELECT b.doc_id, b.text, coalesce(string_agg(b.line, chr(10) ORDER BY b.nth) FILTER (m.nth IS NULL), '') AS kept,
  count(*) FILTER (length(b.bare) > 0) AS n_lines, count(m.nth) AS n_removed_lines
  FROM bare b LEFT JOIN marked m ON b.doc_id = m.doc_id AND b.text = m.text AND b.nth = m.nth GROUP BY b.doc_id, b.text)
SELECT docs.doc_id, rest.kept AS text, rest.n_lines, rest.n_removed_lines FROM docs JOIN rest ON docs.doc_id = rest.doc_id AND docs.text = rest.text
"""
