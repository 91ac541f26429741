"""Fields: melting, codebooks, roles, question types, leakage, contracts and profiles by label."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from respondex.functions import lexicons as L
from respondex.functions import ranking as R
from respondex.functions import sequences as Q
from respondex.functions import text as X


def melt(df: DataFrame, id_cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Respondent x field rows with the raw value as text and its normal form."""
    wide = df.select(*id_cols, *[F.col(c).cast("string").alias(c) for c in fields])
    long_ = wide.unpivot(list(id_cols), list(fields), "field_name", "raw_value")
    return long_.withColumn("normalized_value", X.canonical(F.col("raw_value")))


def to_answers_long(df: DataFrame, id_cols: Sequence[str], fields: DataFrame, names: Sequence[str]) -> DataFrame:
    """Melted answers with the role of each field; ``fields`` has one row per field, so it is broadcast."""
    return melt(df, id_cols, names).join(F.broadcast(fields.select("field_name", "field_role")), "field_name", "left")


def reconcile_counts(long_: DataFrame) -> DataFrame:
    """Per field: rows, answered rows, different answers. Values are combined before they are counted."""
    per_value = long_.groupBy("field_name", "normalized_value").agg(F.count(F.lit(1)).alias("c"))
    answered = F.col("normalized_value").isNotNull()
    return per_value.groupBy("field_name").agg(
        F.sum("c").alias("n_rows"),
        F.coalesce(F.sum(F.when(answered, F.col("c"))), F.lit(0)).alias("n_answered"),
        F.count("normalized_value").alias("n_distinct"),
    )


def field_stats(long_: DataFrame) -> DataFrame:
    """Value statistics of every field, from counts per distinct value."""
    v = F.col("normalized_value")
    per_value = long_.groupBy("field_name", v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    has = F.col("v").isNotNull()
    n = F.sum(F.when(has, F.col("c")).otherwise(0))

    def share(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(has & cond, F.col("c")).otherwise(0)) / n, F.lit(0.0))

    return per_value.groupBy("field_name").agg(
        F.sum("c").alias("n_rows"),
        n.alias("n_answered"),
        F.count("v").alias("n_distinct"),
        F.coalesce(F.sum(F.length("v") * F.col("c")) / n, F.lit(0.0)).alias("mean_length"),
        share(F.length("v") >= 12).alias("long_share"),
        share(F.col("v").try_cast("double").isNotNull()).alias("numeric_share"),
        share(F.col("v").rlike("[A-Za-z]")).alias("alpha_share"),
    )


# --- fixed values: field roles by name, first match wins -----------------------------------------
ROLE_RULES = (
    ("id", r"^(uuid|record|rid)$|(^|_)(id|key)$|custkey$|orderkey$"),
    ("label", r"^status$|^quality$|^toxic$"),
    ("quota", r"^markers$"),
    ("timing", r"^qtime$|duration|elapsed"),
    ("supplier", r"^supname$|^supplier$|^source$"),
    ("ip", r"^ipaddress$"),
    ("user_agent", r"^useragent$"),
    ("timestamp", r"^(date|start_date|ts)$|_ts$|date$"),
    ("technical", r"^(vos|vbrowser|vmobiledevice|vmobileos|props)$"),
    ("nlp_metadata", r"^langassess|^lang$|^n_chars$"),
    ("review_metadata", r"^rd_"),
    ("quality_flag", r"^termflags|flag"),
    ("open_end", r"oe$|^outro$|qcoe|^text$|^open_text$"),
    ("matrix_cell", r"^q\d+r\d+$|_r\d+$"),
    ("demographic", r"^(age|qager1|qgender|qstate|region|nation|segment|mktsegment|classify)$|nation|segment"),
    ("paste_flag", r"pasted"),
    ("no_answer", r"^noanswer"),
    ("routing", r"^conditions"),
    ("product_attr", r"^own|^possible|brand|^p_"),
)


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    rule = None
    for name, pattern in rules:
        rule = F.when(c.rlike(pattern), name) if rule is None else rule.when(c.rlike(pattern), name)
    return rule.otherwise(default)


def classify_field_roles(stats: DataFrame, rules: Sequence[tuple[str, str]] = ROLE_RULES) -> DataFrame:
    """Role of every field by name; a name that says nothing falls back on the values."""
    by_name = first_match(F.lower("field_name"), rules, "")
    by_value = (
        F.when((F.col("mean_length") >= 22) & (F.col("alpha_share") >= 0.25), "open_end")
        .otherwise("coded_question")
    )
    return stats.withColumn("field_role", F.when(by_name == "", by_value).otherwise(by_name))


def infer_question_type(stats: DataFrame) -> DataFrame:
    name = F.lower("field_name")
    numeric = F.col("numeric_share") >= 0.8
    return stats.withColumn(
        "question_type",
        F.when(name.rlike(r"uuid|respondent|^rid$|record|case|(^|_)id$|key$") | name.isin("record", "markers"), "identifier_or_metadata")
        .when(name.rlike(r"qtime|time|duration|elapsed|date|timestamp|(^|_)ts$"), "timing_or_timestamp")
        .when(name.rlike(r"open|other|specify|explain|why|comment|oe$|outro"), "open_end")
        .when(numeric & (F.col("n_distinct") > 10), "numeric")
        .when(numeric, "ordinal_or_numeric")
        .when(name.rlike(r"^(.+?)(_?r|row)\d+(_?c\d+)?$"), "matrix_item")
        .when((F.col("mean_length") >= 20) | (F.col("long_share") >= 0.25), "open_end_like")
        .otherwise("categorical"),
    )


def leakage_columns(columns: Sequence[str], pattern: str = L.LEAKAGE_PATTERN) -> list[str]:
    """Columns that carry the outcome or were written after it. Works on names only."""
    rx = re.compile(pattern)
    return [c for c in columns if rx.search(c)]


def drop_leakage(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in leakage_columns(df.columns) if c not in keep])


def refuse_outcomes(df: DataFrame) -> DataFrame:
    bad = leakage_columns(df.columns)
    if bad:
        raise ValueError(f"outcome-like columns in blind input: {', '.join(bad)}")
    return df


def open_text_columns(stats: DataFrame) -> DataFrame:
    """Fields that hold free text, by name or by values."""
    name = F.lower("field_name")
    technical = name.rlike(r"^(url|useragent|rid|session|source|list|vbrowser|vmobile|vos|vlist)$|token|fingerprint|device")
    leaks = F.col("field_name").rlike(L.LEAKAGE_PATTERN)
    named = name.rlike(r"outro|open|oe$|other|specify|explain|why|comment")
    valued = (F.col("mean_length") >= 22) & (F.col("alpha_share") >= 0.25)
    return stats.where(~technical & ~leaks & (named | valued)).select("field_name", "mean_length", "alpha_share")


def matrix_groups(long_: DataFrame, min_size: int = 4, max_values: int = 12) -> DataFrame:
    """Families of columns named ``<group>r<n>`` of at least ``min_size`` items with 2 to ``max_values`` values."""
    per_value = (
        long_.where(F.col("normalized_value").isNotNull() & ~F.col("field_name").rlike(L.LEAKAGE_PATTERN))
        .groupBy("field_name", "normalized_value").agg(F.count(F.lit(1)).alias("c"))
    )
    items = per_value.groupBy("field_name").agg(F.count(F.lit(1)).alias("values"), F.sum("c").alias("answers"))
    group = F.regexp_extract("field_name", r"^(.+?)(?:_?r|row)\d+(?:_?c\d+)?$", 1)
    return (
        items.where(F.col("values").between(2, max_values)).withColumn("matrix_group", group).where("matrix_group <> ''")
        .groupBy("matrix_group")
        .agg(F.count(F.lit(1)).alias("n_items"), F.max("values").alias("max_values"), F.sum("answers").alias("n_answers"))
        .where(F.col("n_items") >= min_size)
    )


def canonical_key(c: Column) -> Column:
    """Lower case, other characters as ``_``, trailing counter removed."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    key = F.regexp_replace(slug, r"_[0-9]+$", "")
    return F.when(key == "", slug).otherwise(key)


def build_codebook(rows: DataFrame, order: str, sheet: str) -> tuple[DataFrame, DataFrame]:
    """Codebook rows in file order -> (fields with prompts, value labels).

    A row ``[field]: text`` opens a field and the (value, label) rows below it
    belong to that field. The forward fill runs inside ``sheet``, the file or
    sheet a row is from, whose length is that of one questionnaire.
    """
    head = F.regexp_extract("a", r"^\[([^\]]+)\]", 1)
    prompt = F.trim(F.regexp_replace("a", r"^\[[^\]]+\][: ]*", ""))
    w = W.partitionBy(sheet)
    filled = rows.withColumn("_head", F.when(head != "", head)).withColumn("_prompt", F.when(head != "", prompt))
    filled = filled.withColumn("field_name", F.last("_head", ignorenulls=True).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    keys = [sheet, "field_name"]
    is_label = F.col("_head").isNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    labels = (
        filled.where(is_label & F.col("field_name").isNotNull())
        .groupBy(*keys, X.canonical(F.col("b")).alias("value")).agg(F.max_by("c", order).alias("label"))
    )
    heads = filled.where(F.col("_head").isNotNull()).groupBy(*keys).agg(F.max_by("_prompt", order).alias("question_text"))
    return heads, labels


def inherit_prompts(heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A matrix item ``q5r2`` without a prompt takes the prompt of ``q5``."""
    k = list(keys)
    parent = F.regexp_extract("field_name", r"^(.+?)r\d+$", 1)
    parents = heads.select(*k, F.col("field_name").alias("_parent"), F.col("question_text").alias("_pq"))
    return (
        heads.withColumn("_parent", parent).join(parents, [*k, "_parent"], "left")
        .withColumn("question_text", F.when(F.col("question_text") == "", F.coalesce("_pq", F.col("field_name"))).otherwise(F.col("question_text")))
        .drop("_parent", "_pq")
    )


def decode_labels(answers: DataFrame, labels: DataFrame, field: str = "field_name", value: str = "value") -> DataFrame:
    """``value=label`` where the codebook knows the value, the raw value otherwise."""
    return answers.join(labels.select(field, value, "label"), [field, value], "left").withColumn(
        "decoded", F.when(F.col("label").isNull(), F.col(value)).otherwise(F.concat(F.col(value), F.lit("="), F.col("label")))
    )


# --- fixed values: roles and families used by question contracts ---------------------------------
CONTRACT_ROLES = (
    ("technical_identifier", r"uuid|record|session|respondent|rid|ip|device|browser|fingerprint|key"),
    ("timing", r"qtime|time|duration|elapsed|date|timestamp|start|end"),
    ("supplier_source", r"supplier|source|vendor|sample"),
    ("qualification_or_persona", r"qcoe|classify|trade|contractor|role|occupation|profession|job|employment|screen|segment"),
    ("brand_or_product_funnel", r"brand|aware|familiar|use|used|consider|prefer|purchase|recommend|satisfaction|nps|order"),
    ("matrix_or_grid", r"_r\d+|row\d+|grid|matrix|rate|agree|importance|satisf"),
    ("open_end", r"open|other|specify|explain|why|comment|oe|outro"),
    ("demographic", r"gender|age|ethnic|ed|state|employ|income|politic|nation|region|balance"),
)
CONTRACT_FAMILIES = {
    "qualification_or_persona": "qualification and respondent universe",
    "timing": "timing and cognitive burden",
    "matrix_or_grid": "matrix behavior",
    "open_end": "open-ended grounding",
    "brand_or_product_funnel": "brand and product funnel",
    "demographic": "demographics",
}
EXPECTED_EVIDENCE = {
    "qualification_or_persona": "a claim that later answers support",
    "timing": "time plausible for the questions and the depth of the answers",
    "matrix_or_grid": "variation that fits the items",
    "open_end": "a prompt-fit answer grounded in experience",
    "brand_or_product_funnel": "choices consistent along the funnel",
    "demographic": "a value consistent with the profile",
}


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    rule = None
    for k, v in table.items():
        rule = F.when(c == k, v) if rule is None else rule.when(c == k, v)
    return rule.otherwise(default)


def timing_burden(role: Column, n_words: Column) -> Column:
    return (
        F.when(role.isin("open_end", "qualification_or_persona"), "high")
        .when(role == "matrix_or_grid", "medium to high")
        .when(n_words > 18, "medium")
        .otherwise("low")
    )


def question_contracts(stats: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """What each field asks, its role, family, burden and expected evidence, and how well it is answered."""
    prompt = lookup(F.col("field_name"), prompts, "")
    hay = F.lower(F.concat_ws(" ", F.col("field_name"), prompt))
    df = stats.withColumn("question_text", prompt).withColumn("field_role", first_match(hay, CONTRACT_ROLES, "closed_or_categorical"))
    family = F.when(F.col("field_role").isin(*CONTRACT_FAMILIES), lookup(F.col("field_role"), CONTRACT_FAMILIES, "")).when(
        hay.rlike("other|specify"), "other-specify validation"
    ).otherwise("survey response chain")
    return df.select(
        "field_name", "question_text", "field_role", family.alias("question_family"),
        timing_burden(F.col("field_role"), X.word_count(F.col("question_text"), X.LATIN_WORD)).alias("timing_burden"),
        lookup(F.col("field_role"), EXPECTED_EVIDENCE, "a selection that fits the route").alias("expected_evidence"),
        F.round(F.col("n_answered") / F.col("n_rows"), 6).alias("answer_rate"),
        ((F.col("question_text") == "") & (F.col("field_role") == "closed_or_categorical")).cast("int").alias("unresolved"),
    )


# --- fixed values: what an earlier question of the same family means for the later one ------------
FAMILY_RELATIONS = {
    "brand and product funnel": "funnel progression",
    "open-ended grounding": "open/closed contradiction",
    "qualification and respondent universe": "prerequisite",
    "matrix behavior": "parallel matrix context",
}
ANY_FAMILY = "parallel"
SEQUENTIAL = "sequential route context"


def relation_edges(df: DataFrame, id_col: str, pos: str, family: str, relations: dict[str, str] = FAMILY_RELATIONS, hot_rows: int = 100_000) -> DataFrame:
    """``id, source, target, relationship``: every question with the one before it, and with the one before it of its own family.

    ``pos`` is a number, unique for the id, in the order of the questions; gaps
    are allowed, "before" is the next smaller position there is. Questions
    without an id or position take part in nothing, those without a family only
    in the sequence. A respondent with a large share of all questions is ordered
    by ranges (``sequences.ordered``).
    """
    d = df.select(F.col(id_col).alias("_i"), F.col(pos).cast("long").alias("_p"), F.col(family).alias("_f")).where("_i IS NOT NULL AND _p IS NOT NULL")

    def before(rows: DataFrame, key: str) -> DataFrame:
        return Q.ordered(rows.withColumn("_tie", F.col("_p")).withColumn("_at", F.col("_p")), key, "_p", "_tie", "_at", hot_rows).where("prev1 IS NOT NULL")

    route = before(d, "_i").select(F.col("_i").alias(id_col), F.col("prev1").alias("source"), F.col("_at").alias("target"), F.lit(SEQUENTIAL).alias("relationship"))
    own = before(d.where("_f IS NOT NULL").withColumn("_k", F.struct("_i", "_f")), "_k")
    kind = lookup(F.col("_k._f"), relations, ANY_FAMILY) if relations else F.lit(ANY_FAMILY)
    return route.unionByName(own.select(F.col("_k._i").alias(id_col), F.col("prev1").alias("source"), F.col("_at").alias("target"), kind.alias("relationship")))


def routing_subset(df: DataFrame, column: str, isin: Sequence[str] = (), contains: Sequence[str] = (), not_blank: bool = True) -> DataFrame:
    c = F.col(column)
    cond = F.lit(True)
    if not_blank:
        cond = cond & (X.squash(F.coalesce(c, F.lit(""))) != "")
    if isin:
        cond = cond & c.isin(*isin)
    if contains:
        cond = cond & X.contains_any(F.lower(c), tuple(contains))
    return df.where(cond)


def profile_by_label(df: DataFrame, dataset: str, label: str, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Per data set and column: sizes, means and spread by label, effect size, AUROC and rank."""
    d = df.where(F.col(label).isNotNull())
    long_ = d.select(dataset, label, id_col, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [dataset, label, id_col], list(columns), "column", "v"
    )
    rej = F.col(label) == 1

    def side(cond: Column, p: str) -> list[Column]:
        v = F.when(cond, F.col("v"))
        return [
            F.sum(cond.cast("int")).alias(f"{p}_n"),
            F.sum((cond & F.col("v").isNull()).cast("int")).alias(f"{p}_missing"),
            F.avg(v).alias(f"{p}_mean"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{p}_std"),
        ]

    base = long_.groupBy(dataset, "column").agg(*side(~rej, "accepted"), *side(rej, "rejected"))
    pooled = F.sqrt((F.col("accepted_std") * F.col("accepted_std") + F.col("rejected_std") * F.col("rejected_std")) / 2)
    base = base.withColumn("effect", F.when(pooled > 0, (F.col("rejected_mean") - F.col("accepted_mean")) / pooled).otherwise(0.0))
    auc = auroc(long_, [dataset, "column"], "v", label)
    out = base.join(auc.select(dataset, "column", "auroc"), [dataset, "column"], "left").withColumn("auroc", F.coalesce("auroc", F.lit(0.5)))
    flip = F.col("auroc") < 0.5
    out = out.withColumn("effect_size", F.round(F.when(flip, -F.col("effect")).otherwise(F.col("effect")), 4)).withColumn(
        "univariate_auroc", F.round(F.when(flip, 1 - F.col("auroc")).otherwise(F.col("auroc")), 4)
    )
    # the profile has (data sets x columns) rows: windows over it are small
    out = out.withColumn("within_dataset_rank", F.dense_rank().over(W.partitionBy(dataset).orderBy(F.col("univariate_auroc").desc())))
    w = W.partitionBy("column")
    n_ds = F.count(F.lit(1)).over(w)
    out = out.withColumn("datasets", n_ds).withColumn(
        "cross_dataset_stability",
        F.when(n_ds >= 3, "cross_dataset").when(n_ds == 2, "survey_family_specific").otherwise("survey_specific"),
    )
    return out.drop("effect", "auroc")


def auroc(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Rank-sum AUROC with average ranks for ties, from counts per distinct score."""
    rv = R.ranked_values(
        df.where(F.col(score).isNotNull()), groups, score, {"pos": F.col(label).cast("long"), "neg": (1 - F.col(label)).cast("long")}
    )
    won = F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).cast("double")
    p, n = F.max("pos_total"), F.max("neg_total")
    return rv.groupBy(*groups).agg(
        p.alias("n_pos"), n.alias("n_neg"),
        F.when((p > 0) & (n > 0), won / 2 / (p.cast("double") * n.cast("double"))).alias("auroc"),
    )
