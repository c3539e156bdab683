"""Joins and aggregates behind cards, ledgers and reports.

Every function takes DataFrames with the columns that it names and returns one; groups are aggregated, never gathered, but for lists with a
stated bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.dealing import dealt


def last_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the largest order; all columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def with_labels(rows: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the label of their key, null where there's none; of several the last one wins. labels: key, label, order."""
    return rows.join(last_of(labels.select(key, "label", order), [key], order).drop(order), key, "left")


def with_evidence(patterns: DataFrame, evidence: DataFrame, repo: str | None = None, sample: int = 3) -> DataFrame:
    """patterns (id) with n_evidence and the first `sample` refs. With repo: only patterns with evidence in it. evidence: id, repo, ref."""
    if repo is not None:
        patterns = patterns.join(evidence.where(F.col("repo") == repo).select("id").distinct(), "id", "left_semi")
    ranked = evidence.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("ref")))
    per = ranked.groupBy("id").agg(F.count("*").alias("n_evidence"), F.array_sort(F.collect_list(F.when(F.col("rn") <= sample, F.col("ref")))).alias("refs"))
    return patterns.join(per, "id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def member_rollup(members: DataFrame, lowest: int = 3) -> DataFrame:
    """members: module, id, by_locality, confidence. module, n, n_locality, n_structural, confidence (mean), boundary: the least sure ids."""
    ranked = members.withColumn("rn", F.row_number().over(Window.partitionBy("module").orderBy("confidence", "id")))
    return ranked.groupBy("module").agg(
        F.count("*").alias("n"), F.count_if("by_locality").alias("n_locality"), F.count_if(~F.col("by_locality")).alias("n_structural"),
        F.avg("confidence").alias("confidence"), F.array_sort(F.collect_list(F.when(F.col("rn") <= lowest, F.col("id")))).alias("boundary"),
    )


def top_export(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members (id, qualified_name `file::decl::…`) with export: the smallest id of the declaration that stands right below the file, else null."""
    head = F.concat_ws("::", F.slice(F.split("qualified_name", "::"), 1, 2))
    first = nodes.groupBy("qualified_name").agg(F.min("id").alias("export")).withColumnRenamed("qualified_name", "_head")
    return members.withColumn("_head", head).join(first, "_head", "left").drop("_head")


def feature_modules(globs: DataFrame, files: DataFrame, roots: int = 2) -> DataFrame:
    """feature, module, n_files: files (file, module) that a feature's globs match. globs: feature, regex, and root: the literal path that the glob
    starts with, of `roots` folders; an equi-join on that path comes before the match, so that no file meets globs of other folders."""
    head = F.array_join(F.slice(F.split("file", "/"), 1, roots), "/")
    met = files.withColumn("root", head).join(globs, "root").where("file rlike regex").select("feature", "module", "file").distinct()
    return met.groupBy("feature", "module").agg(F.count("*").alias("n_files"))


def coupled_load(loads: DataFrame, grades: DataFrame, soft: dict[str, float], d_hi: float = 0.55, r_min: float = 0.4) -> DataFrame:
    """loads (id, d, r) with grade, the determinacy discounted by it, and the load class that follows. grades: id, grade."""
    from tessera.operators.scoring import load_class

    rate = F.lit(1.0)
    for grade, x in soft.items():
        rate = F.when(F.col("grade") == grade, F.lit(x)).otherwise(rate)
    out = loads.join(grades, "id", "left").withColumn("d_coupled", F.col("d") * rate)
    return out.withColumn("load", load_class(F.col("d_coupled"), F.col("r"), d_hi, r_min))


def feature_kinds(uses: DataFrame) -> DataFrame:
    """uses: feature, kind, role (emit or fold), gated, via. feature, kind, role, gated (any), n_via (distinct)."""
    return uses.groupBy("feature", "kind", "role").agg(F.bool_or("gated").alias("gated"), F.count_distinct("via").alias("n_via"))


def kernel_surface(edges: DataFrame, threshold: int = 2) -> DataFrame:
    """edges: of feature_kinds. kind, n_features, n_emit, n_fold, n_gated (distinct features), is_kernel."""
    of = lambda cond: F.count_distinct(F.when(cond, F.col("feature")))
    per = edges.groupBy("kind").agg(F.count_distinct("feature").alias("n_features"), of(F.col("role") == "emit").alias("n_emit"), of(F.col("role") == "fold").alias("n_fold"), of(F.col("gated")).alias("n_gated"))
    return per.withColumn("is_kernel", F.col("n_features") >= threshold)


def taxonomy_tensions(edges: DataFrame, suffix: str) -> DataFrame:
    """Pairs a < b of kinds that end in suffix and whose first owners (smallest emitting feature) differ. Kinds are a closed alphabet."""
    owner = edges.where((F.col("role") == "emit") & F.col("kind").endswith(suffix)).groupBy("kind").agg(F.min("feature").alias("owner"))
    a, b = owner.select(F.col("kind").alias("a"), F.col("owner").alias("owner_a")), owner.select(F.col("kind").alias("b"), F.col("owner").alias("owner_b"))
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("owner_a") != F.col("owner_b")))


def term_coverage(classes: DataFrame, terms: DataFrame) -> DataFrame:
    """class, n_terms, covered, ratio: how many of a class's terms a glossary has, as they are or as a dotted path's last part. classes: class, term;
    terms: term. An equi-join on the term and on the last part."""
    last = F.element_at(F.split("term", "[.]"), -1)
    known = terms.select("term").unionByName(terms.select(last.alias("term"))).distinct().withColumn("hit", F.lit(1))
    met = classes.distinct().join(known, "term", "left")
    return met.groupBy("class").agg(F.count("*").alias("n_terms"), F.count("hit").alias("covered")).withColumn("ratio", F.col("covered") / F.col("n_terms"))


def verdict_currency(builds: DataFrame, verdicts: DataFrame) -> DataFrame:
    """builds: port, seal, retired; verdicts: port, seal, clean. port, state: retired, undeterminable (no seal), missing, stale (no verdict with its
    seal), unclean, ok."""
    met = builds.join(verdicts.select("port", F.col("seal").alias("v_seal"), "clean"), "port", "left")
    own = F.col("v_seal") == F.col("seal")
    per = met.groupBy("port", "seal", "retired").agg(F.count("v_seal").alias("n"), F.count_if(own).alias("current"), F.coalesce(F.bool_and(F.when(own, F.col("clean"))), F.lit(True)).alias("clean"))
    state = F.when(F.col("retired"), "retired").when(F.col("seal").isNull(), "undeterminable").when(F.col("n") == 0, "missing").when(F.col("current") == 0, "stale").when(~F.col("clean"), "unclean").otherwise("ok")
    return per.select("port", state.alias("state"))


def unique_match(wanted: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """key, n_matches, outcome: matched by exactly one declared row, none, or ambiguous."""
    per = wanted.select(key).distinct().join(declared.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n_matches", F.coalesce("n", F.lit(0)))
    return per.select(key, "n_matches", F.when(F.col("n_matches") == 1, "matched").when(F.col("n_matches") == 0, "none").otherwise("ambiguous").alias("outcome"))


def waivers(punches: DataFrame, decisions: DataFrame) -> DataFrame:
    """target, status: open (a punch without decision), waived, stale (a decision without punch)."""
    a, b = punches.select("target").distinct().withColumn("p", F.lit(1)), decisions.select("target").distinct().withColumn("d", F.lit(1))
    return a.join(b, "target", "full_outer").select("target", F.when(F.col("d").isNull(), "open").when(F.col("p").isNull(), "stale").otherwise("waived").alias("status"))


def affected(agents: DataFrame, changed: DataFrame) -> DataFrame:
    """agents (agent, topics) with a topic among the changed ones (topic): agent, n_topics. An equi-join on the topic, and no list of all changes."""
    return agents.select("agent", F.explode("topics").alias("topic")).distinct().join(changed.select("topic").distinct(), "topic").groupBy("agent").agg(F.count("*").alias("n_topics"))


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """file, fresh: whether any stored hash of the file is its current one. stored, current: file, hash."""
    met = current.join(stored.select("file", F.col("hash").alias("old")), "file", "left")
    return met.groupBy("file").agg(F.coalesce(F.bool_or(F.col("old") == F.col("hash")), F.lit(False)).alias("fresh"))


def exemplars(vectors: DataFrame) -> DataFrame:
    """group, id, similarity: of each group (group, id, vec) the member nearest to the mean by cosine; within 1e-12 the smallest id."""
    each = vectors.select("group", "id", F.posexplode("vec").alias("k", "x"))
    mean = each.groupBy("group", "k").agg(F.avg("x").alias("m"))
    norm = mean.groupBy("group").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    dots = each.join(mean, ["group", "k"]).groupBy("group", "id").agg(F.sum(F.col("x") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("own"))
    sim = dots.join(norm, "group").select("group", "id", (F.col("dot") / F.nullif(F.col("own") * F.col("norm"), F.lit(0.0))).alias("similarity"))
    best = sim.groupBy("group").agg(F.min_by(F.struct("id", "similarity"), F.struct(-F.round("similarity", 12), F.col("id"))).alias("b"))
    return best.select("group", "b.id", "b.similarity")


def semantic_reach(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """id, reach: distinct sources of edges of these kinds. edges: one a row, or with all kinds of a pair in kinds."""
    wanted = F.arrays_overlap("kinds", F.array(*map(F.lit, kinds))) if "kinds" in edges.columns else F.col("kind").isin(*kinds)
    pairs = dealt(edges.where(wanted).select("src_id", "dst_id"), "dst_id", "src_id").distinct()
    return pairs.groupBy(F.col("dst_id").alias("id")).agg(F.count("src_id").alias("reach"))


def field_flow(edges: DataFrame, members: DataFrame) -> DataFrame:
    """source module, target module, kind, n: READS_FIELD and WRITES_FIELD edges between different modules."""
    a, b = members.select(F.col("id").alias("src_id"), F.col("module").alias("source")), members.select(F.col("id").alias("dst_id"), F.col("module").alias("target"))
    met = edges.where(F.col("kind").isin("READS_FIELD", "WRITES_FIELD")).join(a, "src_id").join(b, "dst_id").where("source <> target")
    return met.groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


def fused_candidates(found: DataFrame, bonus: float = 0.1, reach_bonus: float = 0.05) -> DataFrame:
    """found: lane, topic, module, score, reach. topic, module, lanes, score: the best lane's, a bonus for each further lane, one for reach beyond one."""
    per = found.groupBy("topic", "module").agg(F.count_distinct("lane").alias("lanes"), F.max("score").alias("base"), F.max("reach").alias("reach"))
    score = F.col("base") + bonus * (F.col("lanes") - 1) + F.when(F.col("reach") > 1, F.lit(reach_bonus)).otherwise(F.lit(0.0))
    return per.select("topic", "module", "lanes", score.alias("score"))


def richness(signals: DataFrame, entropy: DataFrame, weights: dict[str, float], saturation: float = 3.0, low: float = 0.35, test_floor: float = 0.4) -> DataFrame:
    """id, r: the tier weights of an element's signals (id, tier, is_test), saturated; times 1.2 where its names' entropy (id, h) is low, else 0.5;
    at least test_floor where a test speaks of it; at most 1. Without an entropy the factor is 1."""
    w = F.lit(0.0)
    for tier, x in weights.items():
        w = F.when(F.col("tier") == tier, F.lit(x)).otherwise(w)
    per = signals.groupBy("id").agg(F.sum(w).alias("mass"), F.bool_or("is_test").alias("tested")).join(entropy, "id", "left")
    base = F.least(F.lit(1.0), F.col("mass") / saturation) * F.when(F.col("h").isNull(), 1.0).when(F.col("h") <= low, 1.2).otherwise(0.5)
    return per.select("id", F.least(F.lit(1.0), F.greatest(base, F.when(F.col("tested"), F.lit(test_floor)).otherwise(F.lit(0.0)))).alias("r"))


def conflicts(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """id, detector, critical: nodes whose name, doc or signature doesn't go with what they do. nodes: id, short_name, doc_pure, deprecated, doc_arity, arity.

    read_name_writes: named like a reader, but writes or constructs across its module's border; pure_doc_writes; deprecated_called;
    arity_mismatch. The first two are critical for a port.
    """
    a, b = members.select(F.col("id").alias("src_id"), F.col("module").alias("su")), members.select(F.col("id").alias("dst_id"), F.col("module").alias("sv"))
    writes = edges.where(F.col("kind").isin("WRITES_FIELD", "CONSTRUCTS"))
    across = writes.join(a, "src_id", "left").join(b, "dst_id", "left").where(~F.col("su").eqNullSafe(F.col("sv"))).select(F.col("src_id").alias("id")).distinct()
    some = writes.select(F.col("src_id").alias("id")).distinct()
    called = edges.where("kind = 'CALLS'").select(F.col("dst_id").alias("id")).distinct()
    reader = F.lower("short_name").rlike("^(get|is|has|find|list|read|fetch|load|count)")
    rows = [
        (nodes.where(reader).join(across, "id", "left_semi"), "read_name_writes", True),
        (nodes.where("doc_pure").join(some, "id", "left_semi"), "pure_doc_writes", True),
        (nodes.where("deprecated").join(called, "id", "left_semi"), "deprecated_called", False),
        (nodes.where("doc_arity is not null and arity is not null and doc_arity <> arity"), "arity_mismatch", False),
    ]
    out = None
    for df, name, critical in rows:
        found = df.select("id", F.lit(name).alias("detector"), F.lit(critical).alias("critical"))
        out = found if out is None else out.unionByName(found)
    return out


def role_dissonance(stems: DataFrame, min_members: int = 3, top_share: float = 0.34) -> DataFrame:
    """stems: role, id, stem. Roles of at least min_members whose commonest stem stands in less than top_share of them: role, members, share."""
    n = stems.groupBy("role").agg(F.count_distinct("id").alias("members"))
    top = stems.groupBy("role", "stem").agg(F.count_distinct("id").alias("n")).groupBy("role").agg(F.max("n").alias("top"))
    out = n.join(top, "role").withColumn("share", F.col("top") / F.col("members"))
    return out.where((F.col("members") >= min_members) & (F.col("share") < top_share)).select("role", "members", "share")


def promotions(notes: DataFrame, agents: int = 3) -> DataFrame:
    """notes: topic, agent, kind, flagged. Topics that so many different agents punted on or invented, or that are flagged: topic, n_agents, flagged."""
    counted = F.count_distinct(F.when(F.col("kind").isin("punt", "invented"), F.col("agent")))
    per = notes.groupBy("topic").agg(counted.alias("n_agents"), F.bool_or("flagged").alias("flagged"))
    return per.where((F.col("n_agents") >= agents) | F.col("flagged"))


def coverage_ratchet(targets: DataFrame, readings: DataFrame, baseline: DataFrame) -> DataFrame:
    """target, status: of the targets (target) that nobody has read: known (in the baseline of unread ones) or grown."""
    unread = targets.select("target").distinct().join(readings.select("target").distinct(), "target", "left_anti")
    return unread.join(baseline.select("target").distinct().withColumn("b", F.lit(1)), "target", "left").select("target", F.when(F.col("b").isNull(), "grown").otherwise("known").alias("status"))


def finding_clusters(findings: DataFrame, pattern: str, least: int = 3) -> DataFrame:
    """findings: id, text. token, n: tokens by the pattern that at least so many findings hold."""
    each = findings.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("token"))
    return each.groupBy("token").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= least)


def export_cards(provides: DataFrame) -> DataFrame:
    """provides: module, member, export, edge_kind, edge_count. module, key (export, else the member), n_modes, callers."""
    return provides.groupBy("module", F.coalesce("export", "member").alias("key")).agg(F.count_distinct("edge_kind").alias("n_modes"), F.sum("edge_count").alias("callers"))


def consumes_summary(consumes: DataFrame, top: int = 12) -> DataFrame:
    """consumes: module, external_module, edge_kind, edge_count, internal_id. Of each module's `top` targets (null: an external package) by edges:
    target, n_modes, edges, sample (the smallest internal id)."""
    per = consumes.groupBy("module", F.coalesce("external_module", F.lit("(external package)")).alias("target")).agg(
        F.count_distinct("edge_kind").alias("n_modes"), F.sum("edge_count").alias("edges"), F.min("internal_id").alias("sample")
    )
    return per.withColumn("rn", F.row_number().over(Window.partitionBy("module").orderBy(F.col("edges").desc(), "target"))).where(F.col("rn") <= top).drop("rn")


def shape_cards(shapes: DataFrame, owners: DataFrame) -> DataFrame:
    """type, boundary, n_fields, n_in, n_out, rank: types by their fields' flow; boundary ones first, then those with more fields. owners: id (field), type."""
    from tessera.operators.modules import flow_flag

    flow = flow_flag(F.col("read_inside"), F.col("read_outside"), F.col("written_inside"), F.col("written_outside"))
    each = shapes.withColumn("flow", flow).join(owners, "id")
    per = each.groupBy("type").agg(F.bool_or("boundary").alias("boundary"), F.count("*").alias("n_fields"), F.count_if(F.col("flow").isin("in", "both")).alias("n_in"), F.count_if(F.col("flow").isin("out", "both")).alias("n_out"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("boundary").desc(), F.col("n_fields").desc(), "type")))  # one row a type


def card_summary(interfaces: DataFrame, loads: DataFrame, members: DataFrame) -> DataFrame:
    """module, provides, consumes (edges), critical: the share of its elements whose load is intention-critical; null without elements."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("edge_count")).otherwise(0))
    degrees = interfaces.groupBy("module").agg(side("provides").alias("provides"), side("consumes").alias("consumes"))
    load = loads.join(members.select("id", "module"), "id").groupBy("module").agg((F.count_if(F.col("load") == "intention-critical") / F.count("*")).alias("critical"))
    return degrees.join(load, "module", "left")


def prescreened(seeds: DataFrame) -> DataFrame:
    """seeds: element, soft, shallow. element, screened: at most one seed, all of them soft and shallow."""
    return seeds.groupBy("element").agg(((F.count("*") <= 1) & F.bool_and("soft") & F.bool_and("shallow")).alias("screened"))


def undriven(declared: DataFrame, exercised: DataFrame) -> DataFrame:
    """operation: declared, never exercised."""
    return declared.select("operation").distinct().join(exercised.select("operation"), "operation", "left_anti")


def ledger_state(rows: DataFrame) -> DataFrame:
    """rows: wave, line_no, action, at. wave, opened_at, closed_at, is_open: `open` clears the closing, `close` sets it; the last one counts."""
    last = rows.groupBy("wave").agg(
        F.max_by("at", F.when(F.col("action") == "open", F.col("line_no"))).alias("opened_at"), F.max(F.when(F.col("action") == "open", F.col("line_no"))).alias("o"),
        F.max_by("at", F.when(F.col("action") == "close", F.col("line_no"))).alias("last_closed"), F.max(F.when(F.col("action") == "close", F.col("line_no"))).alias("c"),
    )
    shut = F.col("c").isNotNull() & (F.col("o").isNull() | (F.col("c") > F.col("o")))
    return last.select("wave", "opened_at", F.when(shut, F.col("last_closed")).alias("closed_at"), (~shut).alias("is_open"))


def verdict(bound: Column, provisional: Column, alias_known: Column, answerable: Column, declined: Column, equal: Column, declared: Column, observed_declared: Column) -> Column:
    """Outcome of an assertion, the first that holds: not bound or provisional: no verdict; alias missing: failed; declined: passed where no
    answer is expected, else no verdict; answered though none is expected: failed; equal: passed; a mismatch that's declared with exactly the
    value observed: diverged, else failed."""
    none = F.lit("NO VERDICT")
    return (
        F.when(~bound | provisional, none).when(~alias_known, "FAILED").when(declined, F.when(~answerable, "PASSED").otherwise(none)).when(~answerable, "FAILED")
        .when(equal, "PASSED").when(declared & observed_declared, "DIVERGED").otherwise("FAILED")
    )


def repeated_index(runs: DataFrame) -> DataFrame:
    """runs: run, commit, hash. Runs that hold a hash of the run before: run, repeats, same_commit."""
    before = runs.select((F.col("run") + 1).alias("run"), F.col("commit").alias("old_commit"), "hash").distinct()
    return runs.distinct().join(before, ["run", "hash"]).groupBy("run").agg(F.count("*").alias("repeats"), F.bool_and(F.col("commit") == F.col("old_commit")).alias("same_commit"))


def dominant_stems(names: DataFrame, top: int = 5) -> DataFrame:
    """names: id, name. The commonest words of names in camel or snake case: stem, n."""
    words = F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z]+")
    return names.select("id", F.explode(F.array_distinct(words)).alias("stem")).where("stem <> ''").groupBy("stem").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "stem").limit(top)


def without_role(members: DataFrame, roles: DataFrame) -> DataFrame:
    """Members (id) that are in no role with a centroid (id, has_centroid), whatever the view."""
    return members.select("id").distinct().join(roles.where("has_centroid").select("id"), "id", "left_anti")
