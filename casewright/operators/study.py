"""Search, emphasis, lineage, reviews, listings: the analyses over a corpus's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions import text as X
from casewright.functions.session import cut

# -- search ---------------------------------------------------------------------------------------------

BOOST_FLAGS = ["emphasis_verbal_cue", "returned_to_multiple_times"]


def query_tokens(q: str) -> list[str]:
    import re

    return [t for t in re.findall("[a-z0-9]+", q.lower()) if t not in X.SEARCH_STOPWORDS]


def hits(rows: DataFrame, q: str, kind: str, boost: Column | None = None) -> DataFrame:
    """Rows (id, text) with a positive score as (kind, id, snippet, score); the boost is added to hits only."""
    score = X.match_score(query_tokens(q), F.col("text"))
    df = rows.withColumn("score", score).where("score > 0")
    total = F.col("score") + (boost if boost is not None else F.lit(0.0))
    return df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), X.snippet(F.col("text"), q).alias("snippet"), total.alias("score"))


def search(q: str, limit: int, blocks: DataFrame | None = None, segments: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """The best hits of all kinds, by score, then id. Each table is read once; the limit keeps a few rows a task."""
    parts = []
    if blocks is not None:
        parts.append(hits(blocks, q, "block", F.when(F.col("type") == "case_opinion", 0.5).otherwise(0.0)))
    if segments is not None:
        flagged = F.arrays_overlap("sentiment_flags", F.array(*[F.lit(f) for f in BOOST_FLAGS]))
        parts.append(hits(segments, q, "transcript_segment", F.when(flagged, 0.5).otherwise(0.0)))
    if artifacts is not None:
        parts.append(hits(artifacts, q, "artifact"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("score"), "id", "kind").limit(limit)


# -- emphasis -------------------------------------------------------------------------------------------

CHARS_A_MINUTE = 750
# Weights, the penalty of a disclaimer, and the caps of the signals.
WEIGHTS = {"minutes_on": 0.20, "return_count": 0.25, "hypotheticals_run": 0.25, "engaged_questions": 0.15, "not_disclaimed": 0.15}
PENALTY = -0.50
CAPS = {"minutes_on": 20.0, "return_count": 8.0, "hypotheticals_run": 5.0, "engaged_questions": 6.0}


def subject_features(segments: DataFrame) -> DataFrame:
    """Signals per (transcript, kind, label) from the segments' three mention lists; a label counts once a segment, an empty or null one never."""
    tagged = F.flatten(F.array(*[
        F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("label")))  # noqa: B023
        for k, c in (("case", F.col("mentioned_cases")), ("rule", F.col("mentioned_rules")), ("concept", F.col("mentioned_concepts")))
    ]))
    has = lambda f: F.coalesce(F.array_contains("sentiment_flags", f), F.lit(False))
    length = F.col("end_char") - F.col("start_char")
    df = segments.select(
        "transcript_id", "order_index", F.explode(F.array_distinct(tagged)).alias("s"),
        F.when(length > 0, length / CHARS_A_MINUTE).otherwise(0.0).alias("m"), has("professor_hypothetical").alias("h"),
        has("disclaimed_as_not_testable").alias("d"), has("student_question_professor_engaged").alias("e"), F.left("content", F.lit(80)).alias("c"),
    )
    hypos = F.transform(F.array_sort(F.collect_list(F.when(F.col("h"), F.struct("order_index", "c")))), lambda x: x["c"])
    return df.groupBy("transcript_id", "s.kind", "s.label").agg(
        F.round(F.sum("m"), 6).alias("minutes_on"), F.count(F.lit(1)).alias("return_count"), hypos.alias("hypotheticals_run"),
        F.bool_or("d").alias("disclaimed"), F.count_if("e").alias("engaged_questions"),
    )


def saturated(value: Column, cap: float) -> Column:
    return F.when((value <= 0) | F.lit(cap <= 0), 0.0).otherwise(F.least(value / cap, F.lit(1.0)))


def provisional_score(weights: dict | None = None, caps: dict | None = None, penalty: float = PENALTY) -> Column:
    """The weighted sum of the saturated signals, less the penalty when disclaimed, within 0 and 1."""
    w, c = {**WEIGHTS, **(weights or {})}, {**CAPS, **(caps or {})}
    value = {k: F.col(k) for k in c} | {"hypotheticals_run": F.size("hypotheticals_run")}
    total = sum((w[k] * saturated(value[k], c[k]) for k in c), F.lit(0.0))
    total = total + F.when(F.col("disclaimed"), penalty).otherwise(w["not_disclaimed"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def weights(path: str | None = None) -> tuple[dict[str, float], dict[str, float], float]:
    """(weights, caps, penalty) of the scores from a TOML file; the fixed ones where a value lacks or is no number."""
    import tomllib

    def number(table: object, key: str) -> float:
        if not isinstance(table, dict) or isinstance(table[key], bool) or not isinstance(table[key], int | float):
            raise TypeError(key)
        return float(table[key])

    try:
        with open(path or "", "rb") as f:
            doc = tomllib.load(f)
        w = {k: number(doc.get("weights"), k) for k in WEIGHTS}
        return w, {k: number(doc.get("normalization"), f"{k}_cap") for k in CAPS}, number(doc.get("penalties"), "disclaimed")
    except (OSError, ValueError, KeyError, TypeError):
        return WEIGHTS, CAPS, PENALTY


def emphasis_map(features: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items of transcripts whose replies (transcript_id, content) score their subjects, and warnings on the rest of the replies.

    An item keeps the subject's own signals; its score is brought within 0 and 1, one that is no number is 0. Subjects of another
    kind, or that the features don't know, are passed over.
    """
    item = "array<struct<subject_kind:string,subject_label:string,exam_signal_score:string,justification:string>>"
    rows = replies.select("transcript_id", F.explode(F.from_json(F.get_json_object("content", "$.items"), item)).alias("i")).select(
        "transcript_id", F.col("i.subject_kind").alias("kind"), F.coalesce("i.subject_label", F.lit("")).alias("label"), F.col("i.exam_signal_score").alias("_s"), F.trim(F.coalesce("i.justification", F.lit(""))).alias("justification")
    )
    known = F.col("kind").isin("case", "rule", "concept")
    number = F.expr("try_cast(_s AS double)")
    scored = rows.where(known).withColumns({"_n": number, "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))})
    kept, unknown = reconciled(scored, features)
    odd = kept.where("_n IS NULL AND _s IS NOT NULL").select("transcript_id", "kind", "label", F.lit("score is no number").alias("warning"))
    warned = odd.unionByName(unknown.select("transcript_id", "kind", "label", F.lit("subject is not in the input").alias("warning")))
    warned = warned.unionByName(rows.where(~F.coalesce(known, F.lit(False))).select("transcript_id", "kind", "label", F.lit("unknown kind").alias("warning")))
    return kept.drop("_s", "_n"), warned


def reconciled(returned: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returned subjects that the features know, with them; and those that they don't."""
    keys = ["transcript_id", "kind", "label"]
    return returned.join(features, keys), returned.join(features, keys, "left_anti")


# -- lineage --------------------------------------------------------------------------------------------


def _parents(artifacts: DataFrame) -> DataFrame:
    """(id, to): each artifact's parent, if there is one."""
    edges = artifacts.where("parent_id IS NOT NULL AND parent_id <> id").select("id", "parent_id")
    return edges.join(artifacts.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("id", F.col("parent_id").alias("to"))


def chains(artifacts: DataFrame, max_depth: int = 64, start: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, depth) of every artifact (or those in ``start``), itself at depth 0, by pointer doubling.

    Each round joins the paths with themselves, so 64 steps take six joins. A walk stops at a root, at a
    missing parent, at the depth, and where it would meet an artifact again.
    """
    step, length = cut(_parents(artifacts)), 1
    out = (artifacts if start is None else start).select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    while length < max_depth:
        longer = out.join(step.select(F.col("id").alias("ancestor"), F.col("to")), "ancestor")
        out = cut(out.unionByName(longer.select("id", F.col("to").alias("ancestor"), (F.col("depth") + length).alias("depth"))))
        step = cut(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
        if step.isEmpty():
            break
        length *= 2
    return out.where(F.col("depth") < max_depth).groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))


def lineage_cost(artifacts: DataFrame, events: DataFrame, rounds: int = 6) -> DataFrame:
    """(id, length, total): artifacts on the walk to the root, 2**rounds at most, and the ledger's cost of all of them.

    One row an artifact: each round adds the length and cost of the walk that starts where the row's own ends, which
    doubles both. Only walks that go on after the last round may hold a cycle; these are walked one by one.
    """
    spent = events.groupBy(F.col("artifact_id").alias("id")).agg(F.sum("total_cost_usd").cast("decimal(30,10)").alias("cost"))
    money = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(30,10)")
    own = artifacts.select("id").join(spent, "id", "left").join(_parents(artifacts), "id", "left")
    rows = cut(own.select("id", F.lit(1).cast("long").alias("length"), money(F.col("cost")).alias("total"), "to"))
    for _ in range(rounds):
        if rows.where("to IS NOT NULL").isEmpty():
            break
        further = rows.select(F.col("id").alias("to"), F.col("length").alias("_l"), F.col("total").alias("_t"), F.col("to").alias("_to"))
        both = rows.where("to IS NOT NULL").join(further, "to")
        longer = both.select("id", (F.col("length") + F.col("_l")).alias("length"), money(F.col("total") + F.col("_t")).alias("total"), F.col("_to").alias("to"))
        rows = cut(rows.where("to IS NULL").unionByName(longer))
    done = rows.where("to IS NULL").drop("to")
    left = rows.where("to IS NOT NULL").select("id")
    if left.isEmpty():
        return done
    walk = chains(artifacts, 1 << rounds, left).join(spent.withColumnRenamed("id", "ancestor"), "ancestor", "left")
    return done.unionByName(walk.groupBy("id").agg(F.count(F.lit(1)).alias("length"), money(F.sum("cost")).alias("total")))


def source_summary(sources: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Each source reference with ``found``: true or false for blocks and segments, null for another kind."""
    known = blocks.select(F.lit("block").alias("kind"), F.col("id").alias("ref"), F.lit(True).alias("_f")).unionByName(segments.select(F.lit("transcript_segment").alias("kind"), F.col("id").alias("ref"), F.lit(True).alias("_f"))).distinct()
    found = F.when(F.col("kind").isin("block", "transcript_segment"), F.coalesce("_f", F.lit(False)))
    return sources.join(known, ["kind", "ref"], "left").withColumn("found", found).drop("_f")


# -- reviews --------------------------------------------------------------------------------------------

START = {"ease": 2.5, "interval": 0, "reps": 0}


def sm2(state: Column, grade: Column) -> Column:
    """The next state of a card: struct (ease, interval, reps). Grades outside 0 to 5 are an error."""
    grade = F.when(grade.between(0, 5), grade).otherwise(F.raise_error(F.concat(F.lit("grade outside 0 to 5: "), grade.cast("string"))).cast("int"))
    miss = 5 - grade
    ease = F.greatest(F.lit(1.3), state["ease"] + (0.1 - miss * (0.08 + miss * 0.02)))
    again = F.struct(state["ease"].alias("ease"), F.lit(1).alias("interval"), F.lit(0).alias("reps"))
    days = F.when(state["reps"] == 0, 1).when(state["reps"] == 1, 6).otherwise(F.greatest(F.lit(1), F.bround(state["interval"] * ease).cast("int")))
    passed = F.struct(ease.alias("ease"), days.cast("int").alias("interval"), (state["reps"] + 1).alias("reps"))
    return F.when(grade < 3, again).otherwise(passed)


def review_states(log: DataFrame) -> DataFrame:
    """The state of each card after its reviews (card, at, seq, grade) in order, and when it is due.

    A card's reviews are folded in one row: a card is one learner's, with some hundred reviews in its life.
    """
    zero = F.struct(F.lit(START["ease"]).alias("ease"), F.lit(START["interval"]).alias("interval"), F.lit(START["reps"]).alias("reps"))
    kept = log.groupBy("card").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "grade"))).alias("r"), F.max("at").alias("last_at"))
    df = kept.withColumn("s", F.aggregate("r", zero, lambda s, x: sm2(s, x["grade"])))
    due = F.col("last_at") + F.make_dt_interval(F.col("s.interval"))
    return df.select("card", F.round("s.ease", 6).alias("ease"), "s.interval", "s.reps", "last_at", due.alias("due_at"))


def seeded(cards: DataFrame, states: DataFrame, now: str) -> DataFrame:
    """Fresh states of the cards that have none yet."""
    new = cards.select("card").distinct().join(states, "card", "left_anti")
    return new.select("card", F.lit(2.5).alias("ease"), F.lit(0).alias("interval"), F.lit(0).alias("reps"), F.lit(None).cast("timestamp_ntz").alias("last_at"), F.lit(now).cast("timestamp_ntz").alias("due_at"))


def due(states: DataFrame, cards: DataFrame, now: str, limit: int) -> DataFrame:
    """The cards due first; the limit comes before cards that no longer exist are dropped."""
    queue = states.where(F.col("due_at") <= F.lit(now).cast("timestamp_ntz")).orderBy("due_at", "card").limit(limit)
    return queue.join(cards, "card")


def due_cards(states: DataFrame, artifacts: DataFrame, now: str, limit: int) -> DataFrame:
    """(set_id, card, payload, due_at) of the cards due first, with the card's JSON from its set (states: set_id, card, due_at; artifacts: id, content).

    The limit comes before what no set has any more is dropped; of equal card ids in a set the first counts.
    """
    queue = states.where(F.col("due_at") <= F.lit(now).cast("timestamp_ntz")).orderBy("due_at", "set_id", "card").limit(limit).select("set_id", "card", "due_at")
    held = queue.join(artifacts.select(F.col("id").alias("set_id"), F.from_json(F.get_json_object("content", "$.cards"), "array<string>").alias("cards")), "set_id")
    each = held.select("set_id", "card", "due_at", F.posexplode("cards").alias("at", "payload")).where(F.get_json_object("payload", "$.id") == F.col("card"))
    return each.groupBy("set_id", "card", "due_at").agg(F.min_by("payload", "at").alias("payload")).select("set_id", "card", "payload", "due_at")


# -- listings -------------------------------------------------------------------------------------------


def corpus_summary(corpora: DataFrame, **tables: DataFrame) -> DataFrame:
    """Each corpus with the number of rows that every table has of it; one aggregation and one join a table."""
    out = corpora
    for name, rows in tables.items():
        out = out.join(rows.groupBy(F.col("corpus_id").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{name}")), "id", "left").fillna(0, [f"n_{name}"])
    return out


def type_stats(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("corpus_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest"))


def latest_per(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def titled(artifacts: DataFrame, corpus=None, type_: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
    """Artifacts whose title holds the query; the filter comes before the limit."""
    df = artifacts.withColumn("title", X.title_of(F.col("type"), F.col("id"), F.col("name")))
    df = df if corpus is None else df.where(F.col("corpus_id") == corpus)
    df = df if type_ is None else df.where(F.col("type") == type_)
    df = df if not q else df.where(F.lower("title").contains(q.lower()))
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def largest_book(books: DataFrame) -> DataFrame:
    return books.groupBy("corpus_id").agg(F.max_by("id", F.struct(F.col("page_max") - F.col("page_min"), -F.col("id"))).alias("book_id"))


def orphans(files: DataFrame, live: DataFrame) -> DataFrame:
    """Files whose stem is no live hash; unfinished ones always."""
    part = F.col("name").endswith(".part")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    df = files.withColumn("stem", stem)
    return df.where(part).unionByName(df.where(~part).join(live.select(F.col("hash").alias("stem")), "stem", "left_anti").select(*df.columns))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Old and new rows by key; a field that the new row lacks keeps its old value."""
    o, n = old.select(*keys, F.struct(*fields).alias("_o")), new.select(*keys, F.struct(*fields).alias("_n"))
    return o.join(n, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"_n.{f}"), F.col(f"_o.{f}")).alias(f) for f in fields])
