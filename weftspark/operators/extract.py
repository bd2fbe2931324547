"""Facts from text by patterns, inside the JVM; triples resolved, deduplicated and audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.util import cut, maybe_broadcast

# fixed values: what is looked for
SLACK = r"(?i)(?:slack|WNS|TNS)\s*[=:]\s*([+-]?\d+\.?\d*)\s*(ps|ns)"
SLACK_STATUS = r"slack\s+\((VIOLATED|MET)\)\s+(-?\d+\.?\d*)"
ENDPOINT = r"(?i)(?:Startpoint|Endpoint)\s*:\s*(\S+)"
DRC = r"(?i)(?:violation|error)\s*:\s*(\S+)\s+(?:on\s+)?(?:layer\s+)?(\w+)[^\n]*?\((\d+\.?\d*)\s*,\s*(\d+\.?\d*)\)"
PERIOD = r"create_clock\s+[^\n]*?-period\s+(\d+\.?\d*)"
UNITS = r"set_units\s+[^\n]*?-time\s+(\w+)"
MODULE = r"module\s+(\w+)\s*[#(]"
SETTING = r"export\s+(\w+)\s*=\s*(\S+)"


def matches(df: DataFrame, id_col: str, text: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """(id, pos, groups): every match of the pattern in each text, numbered from 0. Null texts have none."""
    arrays = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()))
    m = df.where(F.col(text).isNotNull()).select(id_col, F.posexplode_outer(arrays).alias("pos", "m")).where("pos is not null")
    return m.select(id_col, "pos", *(F.col(f"m.{n}").alias(n) for n in groups))


def tool_versions(df: DataFrame, id_col: str, text: str, tools: list[str]) -> DataFrame:
    """(id, tool, version): distinct per text; letter case of the tool is kept."""
    pattern = rf"(?i)\b({'|'.join(tools)})\s+(?:v|version\s+)?(\d+\.\d+(?:\.\d+)?)"
    return matches(df, id_col, text, pattern, {"tool": 1, "version": 2}).select(id_col, "tool", "version").distinct()


def path_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, startpoint, endpoint): start and end points paired by position in their text."""
    pins = F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(1))
    idx = F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") - 1)
    d = df.where(F.col(text).isNotNull()).select(id_col, pins.alias("p")).where(F.size("p") >= 2)
    return d.select(id_col, F.explode(F.transform(idx, lambda i: F.struct(F.get("p", i * 2).alias("startpoint"), F.get("p", i * 2 + 1).alias("endpoint")))).alias("x")).select(id_col, "x.*")


def needs_model(path: Column, text: Column, chars: int = 200, covered: Column | None = None, most_covered: float = 0.6) -> Column:
    """Whether a text would go to a model: forum-like path, or guide-like name, long enough, and patterns cover less than a share of it. covered: characters that patterns have taken as evidence, by default none."""
    p = F.lower(path)
    kind = p.rlike("forum|discussion|issue|qa_pair") | F.element_at(F.split(p, "/"), -1).rlike(r"readme|doc|guide|tutorial|\.md|\.rst")
    ok = kind & (F.length(text) >= chars)
    if covered is not None:
        ok = ok & (F.coalesce(covered, F.lit(0)) < most_covered * F.length(text))
    return F.coalesce(ok, F.lit(False))


def resolve_id(label: Column, raw: Column, design: Column, version: Column) -> Column:
    """The normal id of an entity by its label; design and version are the canonical names found for it, or null."""
    c = F.trim(raw)
    low = F.lower(c)
    return (
        F.when(label == "Design", F.concat(F.lit("design_"), F.coalesce(design, low)))
        .when(label == "Version", F.concat(F.lit("version_"), F.coalesce(F.regexp_replace(F.lower(version), r"\.", "_"), low)))
        .when(label == "Module", F.concat(F.lit("module_"), F.regexp_replace(F.regexp_replace(low, "^(module_|cell_|pin_|net_|port_)", ""), r"\s+", "_")))
        .when(label == "Rule", F.concat(F.lit("rule_"), F.regexp_replace(F.regexp_replace(low, "^(rule_|clk_|sdc_)", ""), r"[\s-]+", "_")))
        .when(label == "PDK", F.concat(F.lit("pdk_"), F.regexp_replace(low, "pdk_", "")))
        .when(label.isin("Violation", "Fix", "ToolRun", "Report"), F.concat(F.lower(label), F.lit("_"), low))
        .when(label == "TimingPath", F.concat(F.lit("tp_"), low))
        .otherwise(low)
    )


def alias_table(entities: DataFrame) -> DataFrame:
    """(kind, alias, canonical, ord): lower-case aliases in the order that decides between several."""
    n = F.lower("canonical_name")
    forms = F.array(n, F.regexp_replace(n, "_", ""), F.regexp_replace(n, "-", "_"), F.regexp_replace(n, "_", "."), F.regexp_replace(n, r"\.", "_"))
    a = entities.select("kind", F.col("canonical_name").alias("canonical"), "entity_id", F.posexplode(forms).alias("p", "alias"))
    return a.groupBy("kind", "alias").agg(F.min(F.struct("entity_id", "p", "canonical")).alias("x")).select("kind", "alias", F.col("x.canonical").alias("canonical"), F.concat_ws("/", "x.entity_id", F.col("x.p").cast("string")).alias("ord"))


def resolve(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """triple_id, subject_id, predicate, object_id, confidence, coref_applied after resolution.

    Distinct designs and versions are matched against the aliases (a design either way round, a version where an alias is
    contained), so the theta join is over distinct ids and a reference list. A triple that changes has confidence 0.7 at most.
    """
    al = maybe_broadcast(cut(alias_table(entities)), 10_000)
    ends = triples.select(F.explode(F.array(*(F.struct(F.col(f"{x}_label").alias("label"), F.col(f"{x}_id").alias("raw")) for x in ("subject", "object")))).alias("e")).select("e.*").where("label in ('Design', 'Version') and raw is not null").distinct()
    low = F.lower(F.trim("raw"))
    look = F.when(F.col("label") == "Design", F.regexp_replace(F.regexp_replace(low, "design_", ""), "_", "")).otherwise(F.regexp_replace(F.regexp_replace(low, "tool_", ""), "version_", ""))
    ends = ends.withColumn("look", look)
    design = (F.col("label") == "Design") & (F.col("kind") == "design") & (F.contains("look", "alias") | F.contains("alias", "look"))
    version = (F.col("label") == "Version") & (F.col("kind") == "tool_version") & F.contains("look", "alias")
    found = ends.join(al, design | version).groupBy("label", "raw").agg(F.min_by("canonical", "ord").alias("canonical"))
    out = triples.select("triple_id", "subject_label", "subject_id", "predicate", "object_label", "object_id", "confidence")
    for x in ("subject", "object"):
        f = found.select(F.col("label").alias(f"{x}_label"), F.col("raw").alias(f"{x}_id"), F.col("canonical").alias(f"_{x}"))
        out = out.join(f, [f"{x}_label", f"{x}_id"], "left")
    new = {x: resolve_id(F.col(f"{x}_label"), F.col(f"{x}_id"), F.col(f"_{x}"), F.col(f"_{x}")) for x in ("subject", "object")}
    changed = ~(new["subject"].eqNullSafe(F.col("subject_id")) & new["object"].eqNullSafe(F.col("object_id")))
    conf = F.when(changed, F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(0.7))).otherwise(F.col("confidence"))
    return out.select("triple_id", new["subject"].alias("subject_id"), "predicate", new["object"].alias("object_id"), conf.alias("confidence"), changed.alias("coref_applied"))


def argmax_dedup(triples: DataFrame) -> DataFrame:
    """One triple per (subject_id, predicate, object_id): the most confident, on ties the first. One aggregation, combined on the map side. Null confidence counts as 0."""
    best = F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "triple_id"))
    return triples.groupBy("subject_id", "predicate", "object_id").agg(best.alias("b"), F.count("*").alias("copies")).select("subject_id", "predicate", "object_id", F.col("b.triple_id").alias("triple_id"), (-F.col("b.c")).alias("confidence"), "copies")


def triple_stats(triples: DataFrame) -> DataFrame:
    """(stat, key, n): labels of both ends, predicates, tiers, and confidence bands (0.9 and more high, 0.7 and more medium)."""
    band = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    parts = F.array(
        *(F.struct(F.lit(s).alias("stat"), c.alias("key")) for s, c in [("label", F.col("subject_label")), ("label", F.col("object_label")), ("predicate", F.col("predicate")), ("tier", F.col("extraction_tier").cast("string")), ("confidence", band)])
    )
    return triples.select(F.explode(parts).alias("x")).groupBy("x.stat", "x.key").agg(F.count("*").alias("n"))


# fixed values: predicates and generic ids that the audit knows
KNOWN_PREDICATES = """CAUSES FIXES CONTAINS DEFINED_IN HAS_PORT INSTANCE_OF DEPENDS_ON PRODUCED_BY TARGETS DOCUMENTED_IN USES VERSION_OF INCOMPATIBLE_WITH VIOLATES DIVERGES_FROM HAS_TIMING HAS_METRIC RAN_ON HAS_BUG
BLOCKS HAS_ISSUE REQUIRES IMPLEMENTS CONFIGURES GENERATES REPLACES LACKS OVERRIDES CONFLICTS_WITH SUPPORTS AFFECTS RESOLVES ENABLES REFERENCES RELATED_TO OUTPUTS INPUTS CONNECTS MODIFIES""".split()
GENERIC = "the_tool the_design tool design error fix issue problem solution module file the_file it this result output input command script".split()


def audit(triples: DataFrame) -> DataFrame:
    """(triple_id, verdict, notes): CORRECT, WRONG or UNCERTAIN by ordered checks of ids, predicate, labels and source."""
    s, p, o = F.col("subject_id"), F.col("predicate"), F.col("object_id")
    empty = (F.coalesce(s, F.lit("")) == "") | (F.coalesce(o, F.lit("")) == "")
    gen = lambda c: F.regexp_replace(F.lower(c), "^_+|_+$", "").isin(GENERIC) | (F.length(c) < 3)
    odd = ~F.coalesce(p.isin(KNOWN_PREDICATES), F.lit(False))
    long, hashed = lambda c: F.length(c) > 100, lambda c: c.rlike("^[a-f0-9]{32,}$")
    poor = long(s) | long(o) | hashed(s) | hashed(o)
    verdict = F.when(empty, "WRONG").when(gen(s) | gen(o), "WRONG").when(odd | poor, "UNCERTAIN").otherwise("CORRECT")
    label = lambda c, want: (F.coalesce(c, F.lit("")) != "") & ~c.isin(*want)
    says = lambda when, head, c: F.when(when, F.concat(F.lit(head), c))
    sl, ol, src = F.col("subject_label"), F.col("object_label"), F.coalesce("source_file", F.lit(""))
    # fixed values: the notes' wording
    note = F.concat_ws(
        "; ", says(gen(s), "generic_subject:", s), says(gen(o), "generic_object:", o), says(odd, "unknown_predicate:", F.coalesce(p, F.lit(""))),
        says((p == "FIXES") & label(sl, ["Fix"]), "expected_Fix_label_got:", sl), says((p == "FIXES") & label(ol, ["Violation"]), "expected_Violation_label_got:", ol), says((p == "CAUSES") & label(ol, ["Violation", "Bug", "Error"]), "CAUSES_target_label:", ol),
        F.when(long(s), "subject_id_too_long"), F.when(hashed(s), "subject_looks_like_hash"), F.when(long(o), "object_id_too_long"), F.when(hashed(o), "object_looks_like_hash"),
        F.when(src == "", "no_source_file").when((F.col("extraction_tier") == 3) & F.contains(src, F.lit("forum_llm")), "forum_llm_source"),
    )
    return triples.select("triple_id", verdict.alias("verdict"), F.when(empty, "Empty subject or object ID").when(note == "", "auto_pass").otherwise(note).alias("notes"))


def audit_precision(audited: DataFrame, triples: DataFrame) -> DataFrame:
    """Per predicate: correct, wrong, uncertain and correct / (correct + wrong), 1 where none was judged."""
    j = audited.join(triples.select("triple_id", "predicate"), "triple_id").groupBy("predicate")
    a = j.agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("CORRECT", "WRONG", "UNCERTAIN")))
    return a.withColumn("precision", F.when(F.col("correct") + F.col("wrong") > 0, F.col("correct") / (F.col("correct") + F.col("wrong"))).otherwise(1.0))
