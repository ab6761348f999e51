"""Text, token and scoring functions as Column expressions. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The words that carry no weight in keyword search.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "for", "to", "of", "in", "on", "at", "by", "with", "from",
    "this", "that", "these", "those", "as", "is", "are", "was", "were", "it", "its", "be", "been", "being", "so", "not",
    "no", "do", "does", "did", "you", "your", "yours", "i", "me", "my", "we", "our", "ours", "he", "she", "they", "them",
    "their", "theirs",
)

# Spellings of predicates and their canonical forms.
PREDICATES = {
    "has_name": "name", "is_named": "name", "is_called": "name", "work_at": "works_at", "employed_at": "works_at",
    "live_in": "lives_in", "reside_in": "lives_in", "love": "likes", "enjoy": "likes", "change_to": "switched_to",
    "changed_to": "switched_to", "manages": "manager_of",
}

# Subjects that stand for the speaker.
FIRST_PERSON = ("<user>", "i", "me", "my", "myself", "user")

#: Characters that are cut off both ends of a query's tokens.
EDGES = "?:!\"“”.,;()[]{}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: Column | str) -> Column:
    """Trimmed text with each run of Unicode white space as one space; null gives the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def norm_entity(c: Column | str) -> Column:
    """Lower-case normal text: what facts are keyed by."""
    return F.lower(norm_text(c))


def snake_like(c: Column | str) -> Column:
    """A predicate as lower snake case of ``[a-z0-9_]``."""
    joined = F.regexp_replace(F.lower(norm_text(c)), r"(?U)[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9_]", ""), "_+", "_"), "^_|_$", "")


def canon_predicate(c: Column | str) -> Column:
    """A predicate's canonical name: lower case, spaces as underscores, known variants replaced."""
    own = F.replace(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), F.lit(" "), F.lit("_"))
    table = F.create_map(*[F.lit(x) for pair in PREDICATES.items() for x in pair])
    return F.coalesce(table[own], own)


def keyword_tokens(c: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case ``[A-Za-z0-9_]+`` tokens without stopwords, in order, repeats kept; null gives none."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit("[A-Za-z0-9_]+"), 0)
    lowered = F.transform(found, F.lower)
    return F.filter(lowered, lambda t: ~t.isin(*stopwords)) if stopwords else lowered


def graph_tokens(c: Column | str) -> Column:
    """Lower-case ``[A-Za-z0-9]+`` tokens: underscores separate, nothing is dropped."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit("[A-Za-z0-9]+"), 0), F.lower)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def half_life_weight(age_s: Column, half_life_s: float = 7 * 24 * 3600.0) -> Column:
    """0.5 to the power of age over half-life; unknown age weighs 1, negative age counts as none."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_s) / max(1.0, half_life_s)), F.lit(1.0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 for a zero vector, null for unequal lengths."""
    a, b = _col(a), _col(b)
    add = lambda s, x: s + x
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, add))
    scale = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(scale == 0, zero).otherwise(dot / scale))


def canon_evidence(c: Column | str) -> Column:
    """Lower-case evidence without the punctuation it ends in."""
    bare = F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(bare, "[ \\t\\r\\n.!?、。！？…]+$", "")


def norm_answer(c: Column | str) -> Column:
    """Lower-case answer without white space at its ends."""
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", ""))


def squash(c: Column | str) -> Column:
    """Lower case, with a space for whatever is not ``[a-z0-9]``, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " "))


def stable_id(*parts: Column | str) -> Column:
    """sha1 of the parts, joined by ``::``; nulls count as empty."""
    return F.sha1(F.concat_ws("::", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]))


def looks_like_question(c: Column | str) -> Column:
    """Holds a question mark, or begins with a question word."""
    c = F.coalesce(_col(c), F.lit(""))
    return c.contains("?") | c.rlike(r"(?iU)^\s*(what|who|whom|whose|which|where|when|why|how)\b")


def canon_subject(subject: Column, alias: Column) -> Column:
    """The speaker's alias for first-person subjects (``<USER>`` while it is unknown) and for its other spellings."""
    first = F.lower(F.trim(F.coalesce(subject, F.lit("")))).isin(*FIRST_PERSON)
    same = F.lower(F.trim(subject)) == F.lower(alias)
    return F.when(first, F.coalesce(alias, F.lit("<USER>"))).when(F.coalesce(same, F.lit(False)), alias).otherwise(subject)


def fact_text(subject: Column | str, predicate: Column | str, obj: Column | str) -> Column:
    """``subject | predicate | object``."""
    return F.concat_ws(" | ", *[F.coalesce(_col(c), F.lit("")) for c in (subject, predicate, obj)])


def fact_id(*parts: Column | str) -> Column:
    """A deterministic fact id: the same facts get the same ids in every run."""
    text = F.concat_ws("\x1f", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("fact_"), F.substring(F.sha2(text, 256), 1, 12))


def answer_from_text(c: Column | str, pattern: str = r"(?i)favorite (?:music )?genre is ([^.!?\n]+)") -> Column:
    """What the pattern's first group finds in the text, else the whole text, trimmed."""
    c = F.coalesce(_col(c), F.lit(""))
    found = F.trim(F.regexp_extract(c, pattern, 1))
    return F.when(found != "", found).otherwise(F.trim(c))


def json_array(c: Column | str) -> Column:
    """The JSON array in a model's reply, as text: the reply itself, else what a fence or the outermost brackets hold.

    Null when none of them parses as an array.
    """
    own = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    fence = F.regexp_extract(own, r"(?s)^[^\[]*?```(?:json)?\s*(\[.*?\])\s*```", 1)
    span = F.regexp_extract(own, r"(?s)(\[.*\])", 1)
    valid = lambda x: F.when(F.json_array_length(F.when(x.startswith("["), x)).isNotNull(), x)
    return F.coalesce(valid(own), F.when(fence != "", valid(fence)).otherwise(valid(span)))


def json_object(c: Column | str) -> Column:
    """The text from the first ``{`` to the last ``}``; null when there is none."""
    found = F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def rank_scores(reply: Column | str, n: Column) -> Column:
    """Scores of ``n`` listed items from ``{"scores": [{"index": 1, "score": 2.5}]}``.

    Missing items score 0, of repeated ones the last counts, and an unreadable reply scores 0 throughout.
    """
    rows = F.from_json(json_object(reply), "scores array<struct<index: int, score: double>>")["scores"]
    rows = F.coalesce(rows, F.expr("cast(array() as array<struct<index: int, score: double>>)"))
    last = lambda i: F.try_element_at(F.filter(rows, lambda r: r["index"] == i), F.lit(-1))["score"]
    one = lambda i: F.when(F.exists(rows, lambda r: r["index"] == i), F.coalesce(last(i), F.lit(0.0))).otherwise(F.lit(0.0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)).otherwise(F.expr("cast(array() as array<double>)"))


def clean_tokens(query: Column | str) -> Column:
    """A query's tokens without punctuation at their ends and without a possessive ``'s``."""
    inside = "[" + "".join("\\" + c for c in EDGES) + "]+"
    raw = F.split(norm_text(query), " ")
    bare = F.transform(raw, lambda t: F.replace(F.regexp_replace(t, f"^{inside}|{inside}$", ""), F.lit("’"), F.lit("'")))
    return F.filter(F.transform(bare, lambda t: F.regexp_replace(t, "'[sS]$", "")), lambda t: t != "")


def title_spans(query: Column | str) -> Column:
    """Runs of capitalised tokens, joined by spaces, and then each capitalised token alone; in order, repeats kept."""
    tokens = clean_tokens(query)
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("run"))

    def step(s: Column, t: Column) -> Column:
        capital = t.rlike(r"^\p{Lu}")
        run = F.when(capital, F.when(s["run"] == "", t).otherwise(F.concat(s["run"], F.lit(" "), t))).otherwise(F.lit(""))
        done = F.when(~capital & (s["run"] != ""), F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), run.alias("run"))

    runs = F.aggregate(tokens, start, step, lambda s: F.when(s["run"] != "", F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]))
    return F.concat(runs, F.filter(tokens, lambda t: t.rlike(r"^\p{Lu}")))
