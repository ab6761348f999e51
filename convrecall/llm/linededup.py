"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Lines within ``edits`` edits of each other, cut into ``edits`` + 1 segments, have a segment in common whose place is
off by a bounded number of characters. Each distinct line is indexed by the hashes of its segments with its length;
it probes, for each length it may be the longer one of, the substrings that the multi-match-aware bounds leave. What
meets is verified by banded bit-parallel edit distance, on what lies between the blocks that both lines begin and end
with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convrecall.llm.common import checkpoint, components

#: Edits (of code points) that near-equal lines may be apart.
EDITS = 1
#: Shorter lines are compared exactly only. Lines without a letter are structure rather than text: they stay.
MIN_CHARS = 10
#: Places of lines (two longs and an int each) that may be broadcast when lines are fetched; beyond, a join shuffles.
BROADCAST_PLACES = 200_000
#: Probes of a signature whose lines are paired; larger groups are split.
FEW = 16
#: Characters of the blocks that are compared before the edit distance.
BLOCK = 16

_PLACE = ("doc_id", "row", "line")
_NULL_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); row tells texts of one doc_id apart, and a null doc_id is the least of all."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text"
    )


def _lines(keyed: DataFrame) -> DataFrame:
    """(place, h1, h2, n, content): the lines that hold a letter, with 128 bits of hashes."""
    rows = keyed.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    rows = rows.where(F.rlike("content", F.lit(r"\p{L}"))).withColumn("n", F.length("content"))
    return rows.select(
        F.struct(*_PLACE).alias("place"), F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2"), "n", "content"
    )


def _segment(i: int, edits: int, n: str) -> tuple[str, str]:
    """Start (from 1) and length of segment i (from 1) of a string of n characters, as SQL."""
    parts = edits + 1
    base, longer = f"(({n}) div {parts})", f"(({n}) % {parts})"
    return f"(1 + {i - 1} * {base} + greatest(0, {i - 1} - {parts} + {longer}))", f"({base} + if({i} > {parts} - {longer}, 1, 0))"


def _places(edits: int) -> list[tuple[int, int, str, str, bool]]:
    """(segment, shorter, start, size, own) of all substrings of a line to look at, as SQL over its length n.

    ``own`` ones are the line's own segments: index keys, and probes for lines of its length. The others are probes for
    lines that are ``shorter`` by so many characters, within the multi-match-aware bounds.
    """
    out = []
    for i in range(1, edits + 2):
        for shorter in range(edits + 1):
            at, size = _segment(i, edits, f"n - {shorter}")
            left, right = i - 1, edits + 1 - i
            for off in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                out.append((i, shorter, f"({at} + {off})", size, not shorter and not off))
    return sorted(out, key=lambda x: not x[4])


def _key(i: int, shorter: int, at: str, size: str) -> str:
    return f"if({at} >= 1 and {at} + {size} <= n + 1, xxhash64(n - {shorter}, {i}, substring(content, {at}, {size})), null)"


def _rest(s: str, n: str, at: str, size: str) -> str:
    """A string without the substring that was matched."""
    return f"concat(substring({s}, 1, {at} - 1), substring({s}, {at} + {size}, {n}))"


def candidates(keyed: DataFrame, lines: DataFrame, edits: int, few: int = FEW) -> DataFrame:
    """(a, b), a < b: places of distinct lines that meet under a signature.

    Lines that meet under a signature of at most ``few`` probes are paired. Larger groups are never paired: as the
    matched part took no edit, what is left of their lines must be within the edits too, so that is cut into segments
    again, and the groups split, until they are small or nothing but the edits is left. With one edit such last groups
    are joined by stars; with more edits they are paired.
    """
    looked = _places(edits)
    own = [k for k, x in enumerate(looked) if x[4]]
    keys = [F.expr(_key(*x[:4])).alias(f"k{k}") for k, x in enumerate(looked)]
    rows = lines.select("h1", "h2", "place", *keys)
    rows = checkpoint(
        rows.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(f"k{k}").alias(f"k{k}") for k in range(len(looked))]).drop("h1", "h2")
    )

    def under(names: list[int], at: str, key: str) -> DataFrame:
        each = F.explode(F.array_distinct(F.array(*[F.col(f"k{k}") for k in names]))).alias(key)
        return rows.select(F.col("place").alias(at), each).where(F.col(key).isNotNull())

    probes = under(list(range(len(looked))), "b", "key_b")
    hot = checkpoint(probes.groupBy("key_b").agg(F.count("*").alias("n")).where(F.col("n") > few).select(F.col("key_b").alias("g")))
    index = under(own, "a", "key_a").join(hot, F.col("key_a") == F.col("g"), "left_anti")
    met = index.join(probes, F.expr("key_a = key_b and a <> b")).select("a", "b")
    groups = probes.join(hot, F.col("key_b") == F.col("g"), "left_semi")
    texts = _contents(keyed, checkpoint(groups.select(F.col("b").alias("place")).distinct())).withColumn("n", F.length("content"))
    each = [
        f"struct({_key(*x[:4])} as g, {role} as role, {_rest('content', 'n', x[2], x[3])} as rest, n - {x[1]} - {x[3]} as m)"
        for x in looked for role in ((0, 1) if x[4] else (1,))
    ]
    level = texts.select("place", F.explode(F.expr(f"array({', '.join(each)})")).alias("x")).select("place", "x.*").join(hot, "g", "left_semi")
    level = checkpoint(level.distinct())
    while not level.isEmpty():
        pairs, level = _split(level, edits, few)
        met = met.unionByName(pairs)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _split(level: DataFrame, edits: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the small groups one level down, and the rows of the large ones.

    Rows are (g, role: 0 index or 1 probe, place, rest, m: characters left of the group's index lines).
    """
    last = level.where(F.col("m") <= edits)
    if edits == 1:
        # what is left of a line is in one piece, and all else is equal: rests of one letter are within an edit of each
        # other, so a star joins them; longer ones must share a letter with an index line's
        close = last.where("length(rest) <= 1")
        hub = close.groupBy("g").agg(F.min("place").alias("a"))
        ends = close.join(hub, "g").select("a", F.col("place").alias("b"))
        letter = F.explode(F.array_distinct(F.expr("transform(sequence(1, greatest(1, length(rest))), i -> substring(rest, i, 1))")))
        letters = lambda rows, at: rows.select("g", F.col("place").alias(at), letter.alias("c"))
        ends = ends.unionByName(
            letters(last.where("role = 0"), "a").join(letters(last.where("role = 1 and length(rest) > 1"), "b"), ["g", "c"]).select("a", "b")
        )
    else:  # rests are in several pieces: only comparing the lines tells
        ends = last.where("role = 0").select("g", F.col("place").alias("a")).join(
            last.where("role = 1").select("g", F.col("place").alias("b")), "g"
        ).select("a", "b")

    each = []
    for i in range(1, edits + 2):
        at, size = _segment(i, edits, "m")
        left, right = i - 1, edits + 1 - i
        for off in range(-left, left + 1):
            p = f"({at} + {off})"
            bound = f"{off} >= n - m - {right} and {off} <= n - m + {right} and {p} >= 1 and {p} + {size} <= n + 1"
            test = f"role = 0 and {off} = 0 or role = 1 and {bound}"
            each.append(f"if({test}, struct(xxhash64(g, {i}, substring(rest, {p}, {size})) as g, {_rest('rest', 'n', p, size)} as rest, m - {size} as m), null)")
    more = level.where(F.col("m") > edits).withColumn("n", F.length("rest"))
    more = more.select("role", "place", F.explode(F.expr(f"array({', '.join(each)})")).alias("x")).where("x is not null")
    more = checkpoint(more.select("x.g", "role", "place", "x.rest", "x.m").distinct())
    sizes = more.groupBy("g").agg(F.sum("role").alias("probes"), F.sum(1 - F.col("role")).alias("index"))
    sizes = sizes.where("probes > 0 and index > 0 and probes + index > 2")
    small = more.join(sizes.where(F.col("probes") <= few), "g", "left_semi")
    pairs = small.where("role = 0").select("g", F.col("place").alias("a")).join(small.where("role = 1").select("g", F.col("place").alias("b")), "g")
    found = ends.unionByName(pairs.select("a", "b")).where("a <> b")
    return checkpoint(found), checkpoint(more.join(sizes.where(F.col("probes") > few), "g", "left_semi"))


def _let(value: F.Column, f) -> F.Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _pieces(s: F.Column, size: int) -> F.Column:
    """The string cut after every ``size`` characters, as an array: one pass, where each substring is one of its own."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def banded_distance(a: F.Column, b: F.Column, edits: int) -> F.Column:
    """Edit distance of the longer string a and b where it is at most ``edits`` (15 at most); else ``edits`` + 1.

    Time and memory are in proportion to the strings.

    A string a that is no longer than ``edits`` is within them of any b; its length is given without a look at b.

    Differences down a column are kept as bits of a band that moves along the diagonal: the band's top bit, 31, is
    the row ``edits`` below it.
    """
    if not 0 <= edits <= 15:
        raise ValueError("edits must be 0 to 15")
    letters = F.struct(_pieces(a, 1).alias("a"), _pieces(b, 1).alias("b"))
    return _let(letters, lambda p: _banded(p["a"], p["b"], edits))


def _banded(a: F.Column, b: F.Column, edits: int) -> F.Column:
    m, n = F.size(a), F.size(b)
    full, top = (1 << 32) - 1, 1 << 31
    bits = lambda x: F.lit(x).cast("long")

    def step(s: F.Column, j: F.Column) -> F.Column:
        c = F.get(b, j)
        match = bits(0)
        for k in range(2 * edits + 1):  # null outside of a
            match = match.bitwiseOR(F.when(F.get(a, j + (edits - k)) == c, bits(top >> k)).otherwise(bits(0)))
        vp, vn = s["vp"], s["vn"]

        def down(x: F.Column) -> F.Column:
            diagonal = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(bits(full))
            return _let(diagonal, across)

        def across(d: F.Column) -> F.Column:
            rise = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(bits(full)))
            return _let(F.struct(d.alias("d"), rise.alias("hp"), d.bitwiseAND(vp).alias("hn")), after)

        def after(t: F.Column) -> F.Column:
            d, hp, hn = t["d"], t["hp"], t["hn"]
            half = F.shiftrightunsigned(d, 1)
            flat = bits(top >> 1)  # the row of the last character: it rises through the band, a bit a column
            late = j - (m - edits)
            mask = F.when(late >= 0, F.floor(flat / F.pow(F.lit(2.0), late)).cast("long")).otherwise(bits(0))
            moved = F.when(
                late < 0, F.when(d.bitwiseAND(bits(top)) == 0, 1).otherwise(0)
            ).otherwise(F.when(hp.bitwiseAND(mask) != 0, 1).when(hn.bitwiseAND(mask) != 0, -1).otherwise(0))
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(bits(full))).alias("vp"),
                half.bitwiseAND(hp).alias("vn"),
                (s["d"] + moved).cast("int").alias("d"),
            )

        return _let(match, down)

    start = F.struct(bits(full ^ ((1 << (31 - edits)) - 1)).alias("vp"), bits(0).alias("vn"), F.lit(edits).alias("d"))
    run = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["d"])
    return F.when(m - n > edits, edits + 1).when(m <= edits, m).when(n == 0, m).otherwise(
        F.least(run, F.lit(edits + 1))
    )


def near(a: F.Column, b: F.Column, edits: int) -> F.Column:
    """True where the two strings are within ``edits`` edits, compared between their equal first and last blocks."""

    def shared(x: F.Column, y: F.Column, most: F.Column) -> F.Column:
        """Characters, up to ``most``, of the whole blocks that x and y begin with."""
        blocks = F.struct(_pieces(x, BLOCK).alias("x"), _pieces(y, BLOCK).alias("y"), F.floor(most / BLOCK).cast("int").alias("n"))
        # a null behind the last block differs from it, so there is always a first difference
        same = lambda q: F.transform(F.sequence(F.lit(0), q["n"]), lambda k: (k < q["n"]) & (F.get(q["x"], k) == F.get(q["y"], k)))
        return _let(blocks, lambda q: (F.array_position(same(q), False) - 1).cast("int") * BLOCK)

    def verified(p: F.Column) -> F.Column:
        x, y = p["x"], p["y"]
        return _let(shared(x, y, F.length(y)), lambda head: _let(
            shared(F.reverse(x), F.reverse(y), F.length(y) - head),
            lambda tail: _let(
                F.struct(
                    F.substring(x, head + 1, F.length(x) - head - tail).alias("x"),
                    F.substring(y, head + 1, F.length(y) - head - tail).alias("y"),
                ),
                lambda q: banded_distance(q["x"], q["y"], edits) <= edits,
            ),
        ))

    longer = F.length(a) >= F.length(b)
    return _let(F.struct(F.when(longer, a).otherwise(b).alias("x"), F.when(longer, b).otherwise(a).alias("y")), verified)


def _contents(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """(place, h1, h2, content) of the lines at distinct ``place``."""
    wanted = places.groupBy("place.doc_id", "place.row").agg(F.collect_list("place.line").alias("at"))
    if places.count() <= BROADCAST_PLACES:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
    rows = keyed.join(wanted, ["doc_id", "row"]).withColumn("all", F.split("text", "\n"))
    rows = rows.select("doc_id", "row", "all", F.explode("at").alias("line")).withColumn("content", F.expr("all[line]"))
    rows = rows.select(F.struct(*_PLACE).alias("place"), "content").dropDuplicates(["place"])
    return rows.select("place", F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2"), "content")


def removals(keyed: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, line, root): each line that is not the first of its class, and the place of the one that is."""
    lines = _lines(keyed)
    pairs = checkpoint(candidates(keyed, lines.where(F.col("n") >= min_chars), edits))
    places = checkpoint(pairs.select(F.col("a").alias("place")).unionByName(pairs.select(F.col("b").alias("place"))).distinct())
    texts = checkpoint(_contents(keyed, places))
    side = lambda c: texts.select(F.col("place").alias(c), F.col("content").alias(f"text_{c}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(near(F.col("text_a"), F.col("text_b"), edits)).select("a", "b")
    joined = components(links)
    classes = texts.select("place", "h1", "h2").join(joined, F.col("place") == F.col("node")).select("h1", "h2", F.col("component").alias("root"))
    exact = lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    roots = exact.join(classes, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("root", "first").alias("root"))
    return lines.select("h1", "h2", "place").join(roots, ["h1", "h2"]).where("place <> root").select("place.*", "root")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with lines of ``text`` removed, and ``n_lines`` and ``n_removed``; every row stays.

    Lines are what line feeds separate. Lines that hold a letter and are equal, or joined by a chain of lines of at
    least ``min_chars`` code points within ``edits`` edits of each other, are a class, and only its first line stays:
    the least by doc_id (null first), a hash of the row, and line number. Blank lines and lines without a letter stay.
    A null text has no lines and stays null; an empty one has one. Rows alike in doc_id and text count as one document
    and are treated alike. Other columns are passed on; columns named as the two new ones are replaced.
    """
    mine = {"doc_id": "doc_id__k", "row": "row__k"}
    drop = removals(_keyed(docs), edits, min_chars).groupBy("doc_id", "row").agg(F.collect_set("line").alias("drop__k")).withColumnsRenamed(mine)
    rows = docs.withColumn("id__k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).withColumn("hash__k", F.xxhash64("doc_id", "text"))
    rows = rows.join(drop, (F.col("id__k") == F.col("doc_id__k")) & (F.col("hash__k") == F.col("row__k")), "left")
    rows = rows.withColumn("all__k", F.split("text", "\n")).withColumn("n_lines", F.coalesce(F.size("all__k"), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
    rows = rows.withColumn("n_removed", F.when(F.col("drop__k").isNull(), F.lit(0)).otherwise(F.size("drop__k")).cast("long"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all__k") - 1), "drop__k"), lambda i: F.get("all__k", i))
    rows = rows.withColumn("text", F.when(F.col("drop__k").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")))
    return rows.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def line_sql(docs: str) -> str:
    """Line classes in DuckDB SQL, as ``kept(doc_id, text, n_lines, n_removed)`` over ``docs``: for unique doc_ids and EDITS = 1.

    Near lines are found by their halves: one edit leaves the first or the last half of the shorter line untouched.
    """
    return f"""
lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS content FROM {docs} WHERE text IS NOT NULL
), kinds AS (
  SELECT content, length(content) AS n, min([doc_id, line]) AS place FROM lines WHERE regexp_matches(content, '\\pL') GROUP BY content
), halves AS (
  SELECT content, place, n, unnest([n, n - 1]) AS m FROM kinds WHERE n >= {MIN_CHARS}
), sides AS (
  SELECT content, place, m, substr(content, 1, m // 2) AS h, 0 AS side FROM halves
  UNION ALL SELECT content, place, m, right(content, m - m // 2) AS h, 1 FROM halves
), links AS (
  SELECT DISTINCT a.place AS a, b.place AS b FROM sides a JOIN sides b
    ON a.m = b.m AND a.side = b.side AND a.h = b.h AND a.content <> b.content AND levenshtein(a.content, b.content) <= {EDITS}
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT k.content, least(k.place, coalesce(min(r.b), k.place)) AS root FROM kinds k LEFT JOIN reach r ON r.a = k.place GROUP BY k.content, k.place
), kept AS (
  SELECT d.doc_id,
    CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(l.content, chr(10) ORDER BY l.line)
      FILTER (WHERE r.root IS NULL OR r.root = [l.doc_id, l.line]), '') END AS text,
    count(l.line) AS n_lines, count(*) FILTER (WHERE r.root <> [l.doc_id, l.line]) AS n_removed
  FROM {docs} d LEFT JOIN lines l USING (doc_id) LEFT JOIN roots r USING (content) GROUP BY d.doc_id
)"""


OP2_SQL = f"""
WITH RECURSIVE {line_sql("documents")}
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""
