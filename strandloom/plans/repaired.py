"""Queries of the repairs, of what must survive them, and of the decisions on proposed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import repairs
from strandloom.operators import drafts, members
from strandloom.plans.registry import query
from strandloom.plans.tables import UTT, table, utterances
from strandloom.sources import versions


@query()
def spacing_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with misplaced joins repaired, and what was changed; DuckDB's patterns can't look ahead, so tests hold it against values by hand and by brute force."""
    text, changes = repairs.repaired_spacing(F.col("ko"))
    return utterances(spark, sf_dir).select("conv_id", "turn", text.alias("repaired"), F.size(changes).cast("long").alias("n_changes"), F.to_json(changes).alias("changes"))


@query()
def cleanup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances, with events, fillers and repeats as recognition leaves them, cleaned up; and how many changes that took."""
    spoken = F.concat(F.lit("[음악] 어 좀 어 좀 "), "ko", F.lit(" 음 그 그 그 A 요런 것"))
    text, n = repairs.cleaned_up(spoken)
    return utterances(spark, sf_dir).select("conv_id", "turn", text.alias("cleaned"), n.cast("long").alias("n_changes"))


_SAID = "'Then click ' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' and say ' || p_type || ', ' || CASE WHEN p_partkey % 2 = 0 THEN 'say ' || lower(p_type) || ', ' ELSE 'say it, ' END || CASE WHEN p_partkey % 3 = 0 THEN '{{slash}} command run now and open' ELSE 'type ok' END"


@query(f"""
WITH s AS (SELECT p_partkey, {_SAID.format()} AS x, p_name, p_type FROM part),
f AS (SELECT p_partkey, list_distinct(list_concat(CASE WHEN p_partkey % 3 = 0 THEN ['run now'] ELSE [] END, list_concat([p_name], CASE WHEN p_partkey % 3 <> 0 THEN ['ok'] ELSE [] END), CASE WHEN p_partkey % 2 = 0 THEN [p_type, lower(p_type)] ELSE [] END)) AS t FROM s)
SELECT p_partkey, len(t)::BIGINT AS n, array_to_string(list_sort(t), ',') AS targets FROM f
""")
def literal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal targets of instructions made from parts: what is clicked, typed, run, or said twice."""
    even, third = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0
    said = F.concat(F.lit("Then click "), "p_name", F.lit(" and say "), "p_type", F.lit(", "), F.when(even, F.concat(F.lit("say "), F.lower("p_type"), F.lit(", "))).otherwise("say it, "), F.when(third, "{slash} command run now and open").otherwise("type ok"))
    t = repairs.literal_targets(said)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(t).cast("long").alias("n"), F.array_join(F.array_sort(t), ",").alias("targets"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '''s ' || p_name WHEN 1 THEN p_brand || '''s ' || p_name ELSE p_name END AS name FROM part
""")
def composite_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and their brands in one form, whichever way they are written."""
    third = F.col("p_partkey") % 3
    written = F.when(third == 0, F.concat("p_name", F.lit(" By "), "p_brand")).when(third == 1, F.concat("p_brand", F.lit("’s  "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", repairs.ownership(written).alias("name"))


@query(r"""
WITH l AS (SELECT conv_id, turn, replace(text, ' la ', ' `la` ') AS x FROM conversations), p AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '`[^`]+`|[^`]+')) AS c FROM l)
SELECT conv_id, turn, count(*) AS n_parts, count(*) FILTER (WHERE c LIKE '`%') AS n_code, sum(length(replace(c, '`', '')))::BIGINT AS n_chars FROM p GROUP BY 1, 2
""")
def rich_text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as parts of text and code."""
    p = repairs.rich_parts(F.replace("text", F.lit(" la "), F.lit(" `la` ")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(p).alias("p"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_parts"), F.count_if(F.col("p.kind") == "code").alias("n_code"), F.sum(F.char_length("p.value")).alias("n_chars"))


@query(f"""
WITH {UTT}, ch AS (SELECT conv_id, chapter, min(start_s) AS lo, CASE WHEN (conv_id + chapter) % 2 = 0 THEN 'The API chapter' ELSE 'AI' END AS label, lead(min(start_s)) OVER (PARTITION BY conv_id ORDER BY chapter) AS hi FROM utt GROUP BY 1, 2),
m AS (SELECT * FROM (VALUES ('api', 'API'), ('ai 도구', 'A.I.'), ('ui', 'UI')) AS t(phrase, canonical)),
h AS (SELECT u.conv_id, phrase, canonical, contains(regexp_replace(lower(label), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(canonical), '[^a-z0-9]+', '', 'g')) OR contains(regexp_replace(lower(canonical), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')) AS named FROM utt u JOIN m ON contains(lower(ko), phrase) JOIN ch ON ch.conv_id = u.conv_id AND u.start_s >= lo AND (hi IS NULL OR u.start_s < hi))
SELECT conv_id, phrase, count(*) AS n_seen, bool_or(named) AS supported FROM h GROUP BY 1, 2
""")
def phrase_chapter_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a phrase is said in a chapter whose label names its canonical form. A segment's chapter is that of the last start before it."""
    u = utterances(spark, sf_dir)
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    terms = {"api": "API", "ai 도구": "A.I.", "ui": "UI"}
    label = F.when((F.col("conv_id") + F.col("chapter")) % 2 == 0, "The API chapter").otherwise("AI")
    seen = F.array_compact(F.array(*[F.when(F.contains(F.lower("ko"), F.lit(p)), F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("canonical"))) for p, c in terms.items()]))
    rows = u.select("conv_id", label.alias("label"), F.explode(seen).alias("s"))
    named = F.contains(key(F.col("label")), key(F.col("s.canonical"))) | F.contains(key(F.col("s.canonical")), key(F.col("label")))
    return rows.groupBy("conv_id", "s.phrase").agg(F.count("*").alias("n_seen"), F.bool_or(named).alias("supported"))


@query(f"""
WITH {UTT}, a AS (SELECT conv_id, turn, start_s, end_s FROM utt), j AS (SELECT x.conv_id, x.turn, s.turn AS c FROM a x JOIN a s ON s.conv_id = x.conv_id AND CASE WHEN x.turn % 3 = 0 THEN s.end_s >= x.start_s - 8 AND s.start_s <= x.end_s + 8 ELSE abs(s.turn - x.turn) <= 2 END)
SELECT conv_id, turn, count(*) AS n, string_agg(c, ',' ORDER BY c) AS candidates FROM j GROUP BY 1, 2
""")
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that may belong to an utterance: two places around those it names, or, where it names none, within eight seconds.

    Times meet by blocks of 16 seconds, so no segment is held against all of its video.
    """
    u = utterances(spark, sf_dir).select("conv_id", "turn", "start_s", "end_s")
    s = u.select("conv_id", F.col("turn").alias("c"), F.col("start_s").alias("s0"), F.col("end_s").alias("s1"))
    named = u.where("turn % 3 <> 0").select("conv_id", "turn", F.explode(F.sequence(F.col("turn") - 2, F.col("turn") + 2)).alias("c")).join(s.select("conv_id", "c"), ["conv_id", "c"])
    block = lambda x: F.floor(x / 16)
    timed = u.where("turn % 3 = 0").withColumn("b", F.explode(F.sequence(block(F.col("start_s") - 8), block(F.col("end_s") + 8))))
    spread = s.withColumn("b", F.explode(F.sequence(block(F.col("s0")), block(F.col("s1")))))
    met = timed.join(spread, ["conv_id", "b"]).where("s1 >= start_s - 8 AND s0 <= end_s + 8").select("conv_id", "turn", "c").distinct()
    rows = named.select("conv_id", "turn", "c").union(met).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return rows.select("conv_id", "turn", F.size("cs").cast("long").alias("n"), F.array_join(F.transform("cs", lambda c: c.cast("string")), ",").alias("candidates"))


@query("""
WITH t AS (SELECT l_orderkey AS id, bool_and(s_acctbal IS NOT NULL AND s_acctbal >= 3000) AS all_strong FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'N' GROUP BY 1),
o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'repair' WHEN 'O' THEN 'keep' ELSE 'unresolved' END AS decision, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS confidence, o_totalprice < 200000 AS guarded FROM orders)
SELECT o.id, CASE WHEN decision <> 'repair' OR confidence = 'low' THEN CASE WHEN decision = 'unresolved' THEN 'unresolved' ELSE 'model_reviewed' END WHEN confidence = 'medium' AND NOT coalesce(all_strong, false) THEN 'unresolved' WHEN NOT guarded THEN 'unresolved' ELSE 'model_reviewed' END AS state,
 CASE WHEN decision <> 'repair' OR confidence = 'low' THEN CASE WHEN decision <> 'keep' THEN 'model_unresolved' END WHEN confidence = 'medium' AND NOT coalesce(all_strong, false) THEN 'fidelity_guard:medium_confidence_without_deterministic_entity_support' WHEN NOT guarded THEN 'fidelity_guard:failed' END AS reason FROM o LEFT JOIN t USING (id)
""")
def model_review_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed repairs: high confidence counts after the guard, medium only if all that it brings in is strong; else unresolved, and why."""
    strong = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") >= 3000).alias("strong"))
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    targets = l.join(strong, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_and(F.coalesce("strong", F.lit(False))).alias("all_strong"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(status == "F", "repair").when(status == "O", "keep").otherwise("unresolved").alias("decision"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "high").when(priority == "3-MEDIUM", "medium").otherwise("low").alias("confidence"),
        (F.col("o_totalprice") < 200000).alias("guarded"),
    )
    j = o.join(targets, "id", "left")
    idle = (F.col("decision") != "repair") | (F.col("confidence") == "low")
    weak = (F.col("confidence") == "medium") & ~F.coalesce("all_strong", F.lit(False))
    state = F.when(idle, F.when(F.col("decision") == "unresolved", "unresolved").otherwise("model_reviewed")).when(weak | ~F.col("guarded"), "unresolved").otherwise("model_reviewed")
    reason = F.when(idle, F.when(F.col("decision") != "keep", "model_unresolved")).when(weak, "fidelity_guard:medium_confidence_without_deterministic_entity_support").when(~F.col("guarded"), "fidelity_guard:failed")
    return j.select("id", state.alias("state"), reason.alias("reason"))


@query("""
WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{}' WHEN 3 THEN '{"k": 200}' ELSE 'null' END AS raw FROM events)
SELECT event_id, CASE WHEN json_type(raw) <> 'OBJECT' THEN 'not_an_object' WHEN json_type(raw, '$.k') IS NULL THEN 'k_missing' WHEN json_type(raw, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'k_must_be_a_whole_number' WHEN (raw->>'$.k')::BIGINT NOT BETWEEN 0 AND 99 THEN 'k_out_of_range' ELSE 'ok' END AS verdict FROM r
""")
def structural_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents have the structure they must have: object, field, type, range."""
    five = F.col("event_id") % 5
    raw = F.when(five == 0, F.col("props")).when(five == 1, '{"k": "x"}').when(five == 2, "{}").when(five == 3, '{"k": 200}').otherwise("null")
    k = F.get_json_object("raw", "$.k")
    r = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    typed = F.expr("schema_of_variant(try_variant_get(try_parse_json(raw), '$.k', 'variant'))")
    verdict = F.when(~F.expr("schema_of_variant(try_parse_json(raw))").startswith("OBJECT"), "not_an_object").when(k.isNull(), "k_missing").when(typed != "BIGINT", "k_must_be_a_whole_number").when(~k.try_cast("long").between(0, 99), "k_out_of_range").otherwise("ok")
    return r.select("event_id", verdict.alias("verdict"))


@query("""
WITH s AS (SELECT l_orderkey AS draft, CASE WHEN l_linenumber = 1 AND l_suppkey >= 50 THEN 9 ELSE l_linenumber END AS part, l_suppkey AS step, l_quantity FROM lineitem),
e AS (SELECT DISTINCT draft, step, step * 2.0::DOUBLE AS s0, step * 2.0::DOUBLE + 1 AS s1 FROM s WHERE l_quantity > 10),
p AS (SELECT s.draft, part, count(DISTINCT s.step) AS n_steps, min(s0) AS start_s, max(s1) AS end_s FROM s LEFT JOIN e ON e.draft = s.draft AND e.step = s.step GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY part) AS r FROM p WHERE part <> 3), a AS (SELECT draft, part, n_steps, start_s, end_s, CASE WHEN r < 1 THEN r * 2 ELSE r * 2 + 2 END AS pos FROM o UNION ALL SELECT draft, part, n_steps, start_s, end_s, 2 FROM p WHERE part = 3)
SELECT draft, part, n_steps, start_s, end_s, row_number() OVER (PARTITION BY draft ORDER BY pos, part) AS new_order FROM a
""")
def draft_rearranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts after a part was split at a step and another moved to the front, with counts and bounds derived from evidence."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_linenumber").alias("part"), F.col("l_suppkey").alias("step"), "l_quantity")
    steps = drafts.split_part(l, part=1, at_step=50, new_part=9)
    evidence = steps.where("l_quantity > 10").select("draft", "step", (F.col("step") * 2.0).alias("start_s"), (F.col("step") * 2.0 + 1).alias("end_s")).distinct()
    parts = drafts.derived(steps.select("draft", "part", "step").distinct(), evidence)
    return drafts.move_part(parts, "draft", 3, 1).select("draft", "part", "n_steps", "start_s", "end_s", "new_order")


@query("""
SELECT doc_id, source, lang, 2 AS version FROM documents WHERE n_chars >= 200 UNION ALL SELECT doc_id, 'label', quality::VARCHAR, 2 FROM labels
""")
def published_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables published as one version, twice, and the newest read back."""
    folder = f"{members.shared_folder(spark)}/published-{members.tag()}"
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    for least in (0, 200):
        number = versions.publish({"documents": d.where(F.col("n_chars") >= least).drop("n_chars"), "labels": l}, folder)
    newest = versions.version(spark, folder, number)
    docs, labels = newest.read(spark, "documents"), newest.read(spark, "labels")
    return docs.union(labels.select("doc_id", F.lit("label"), F.col("quality").cast("string"))).withColumn("version", F.lit(number))


@query()
def source_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text holds that an output must keep, and what its lower-case form lacks."""
    said = F.concat_ws(" ", "text", F.lit('See https://example.org/a, read notes.md, take 3.5 GB or 20% of "two words" in ChatGPT and Figma.'))
    warnings = repairs.fidelity_warnings(said, F.lower(said))
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", repairs.exact_values(said).alias("exact"), repairs.latin_names(said).alias("names"), warnings.alias("warnings"))
    return d.select("conv_id", "turn", F.size("exact").cast("long").alias("n_exact"), F.size("names").cast("long").alias("n_names"), F.size("warnings").cast("long").alias("n_warnings"), F.sha2(F.array_join(F.array_sort("warnings"), "\n"), 256).alias("warnings"))


@query(f"""
WITH {UTT}, c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'corrected' ELSE 'open' END AS status, turn % 8 = 0 AS confirmed, CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE 'human ' || turn END AS human, CASE WHEN turn % 3 = 0 THEN ' final ' || turn END AS final, CASE WHEN turn % 3 = 1 THEN '  ' ELSE ko END AS normalized, CASE WHEN (conv_id + turn) % 4 = 0 THEN '' ELSE 'auto' END AS auto FROM utt)
SELECT conv_id, turn, coalesce(CASE WHEN status = 'corrected' AND confirmed THEN nullif(trim(human), '') END, nullif(trim(final), ''), nullif(trim(normalized), ''), nullif(trim(auto), ''), '') AS display FROM c
""")
def final_text_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that counts: a confirmed human correction, else the final, the normalised or the automatic one, the first that isn't blank."""
    turn, conv = F.col("turn"), F.col("conv_id")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    human = F.when(conv % 5 == 0, " ").otherwise(F.concat(F.lit("human "), turn.cast("string")))
    corrected = F.when((turn % 4 == 0) & (turn % 8 == 0), some(human))
    final = F.when(turn % 3 == 0, F.concat(F.lit(" final "), turn.cast("string")))
    normalized = F.when(turn % 3 == 1, "  ").otherwise(F.col("ko"))
    auto = F.when((conv + turn) % 4 == 0, "").otherwise("auto")
    return utterances(spark, sf_dir).select("conv_id", "turn", F.coalesce(corrected, some(final), some(normalized), some(auto), F.lit("")).alias("display"))


_ITEMS = """[CASE WHEN l_returnflag = 'R' AND l_discount < 0.03 THEN {'r': 1, 't': 'unassigned_phase', 's': 'blocking'} END, CASE WHEN l_quantity > 45 THEN {'r': 2, 't': 'phase_context_too_broad', 's': 'warning'} END, CASE WHEN l_tax > 0.07 THEN {'r': 3, 't': 'part_needs_review', 's': 'blocking'} END, CASE WHEN l_discount > 0.09 THEN {'r': 4, 't': 'excluded_action', 's': 'warning'} END, CASE WHEN l_suppkey % 9 = 0 THEN {'r': 5, 't': 'unattached_context', 's': 'warning'} END, CASE WHEN l_linestatus = 'O' AND l_quantity < 3 THEN {'r': 6, 't': 'step_needs_review', 's': 'blocking'} END, CASE WHEN l_partkey % 50 = 0 THEN {'r': 7, 't': 'unsupported_claim_removed', 's': 'warning'} END]"""


@query(f"""
WITH i AS (SELECT l_orderkey AS draft, l_linenumber AS part, l_suppkey AS step, unnest(list_filter({_ITEMS}, lambda x: x IS NOT NULL)) AS x FROM lineitem),
a AS (SELECT draft, part, step, x.r AS r, x.t AS type, x.s AS severity FROM i UNION ALL SELECT o_orderkey, 0, 0, 8, 'script_not_human_verified', 'warning' FROM orders WHERE o_orderstatus <> 'F')
SELECT draft, 'REV-' || lpad((row_number() OVER (PARTITION BY draft ORDER BY r, part, step))::VARCHAR, 3, '0') AS review_id, type, severity, part FROM a
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that must be looked at in a draft, of eight types, blocking or not, with running ids. One pass finds what a row says, whatever the types."""
    c = F.col
    found = [
        ("unassigned_phase", "blocking", (c("l_returnflag") == "R") & (c("l_discount") < 0.03)),
        ("phase_context_too_broad", "warning", c("l_quantity") > 45),
        ("part_needs_review", "blocking", c("l_tax") > 0.07),
        ("excluded_action", "warning", c("l_discount") > 0.09),
        ("unattached_context", "warning", c("l_suppkey") % 9 == 0),
        ("step_needs_review", "blocking", (c("l_linestatus") == "O") & (c("l_quantity") < 3)),
        ("unsupported_claim_removed", "warning", c("l_partkey") % 50 == 0),
    ]
    items = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(r).alias("r"), F.lit(t).alias("type"), F.lit(s).alias("severity"))) for r, (t, s, test) in enumerate(found, 1)]))
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("draft"), c("l_linenumber").alias("part"), c("l_suppkey").alias("step"), F.explode(items).alias("x")).select("draft", "part", "step", "x.*")
    script = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(c("o_orderkey").alias("draft"), F.lit(0).alias("part"), F.lit(0).alias("step"), F.lit(8).alias("r"), F.lit("script_not_human_verified").alias("type"), F.lit("warning").alias("severity"))
    nth = F.row_number().over(Window.partitionBy("draft").orderBy("r", "part", "step"))
    return rows.unionByName(script).select("draft", F.format_string("REV-%03d", nth).alias("review_id"), "type", "severity", "part")
