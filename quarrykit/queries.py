"""Queries of the operators over the provided tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit import rules
from quarrykit.functions import text as X
from quarrykit.operators import behavior, cfg, inference, instructions, runtime, strings, xrefs
from quarrykit.plans import adapters as A
from quarrykit.plans import decompile
from quarrykit.plans.shared import written


def _classed(s, d):
    return instructions.classes(A.instructions(s, d))


def _entries(s, d):
    return A.instructions(s, d).groupBy("binary_id").agg(F.min_by("address", "seq").alias("address"))


def _members(s, d):
    c = _classed(s, d)
    return instructions.members(c, instructions.seeds(c, _entries(s, d)))


def _no_imports(s):
    return s.createDataFrame([], "binary_id long, library string, function string, address long, ord long")


def suspicious_strings(s, d):
    return strings.suspicious(A.strings(s, d)).select("binary_id", "address", "symbol", "value", "category")


def string_dedupe(s, d):
    return strings.dedupe(A.strings(s, d).where("binary_id >= 0")).select("binary_id", "value", "address")


def decode_recipes(s, d):
    return strings.recipes(A.strings(s, d)).select("binary_id", "address", "symbol", "value", "signal", "confidence", "reason")


def decode_links(s, d):
    return strings.recipes(A.strings(s, d)).select("binary_id", "address", "recipe", "deep_link")


def api_insights(s, d):
    return behavior.api_insights(A.imports(s, d)).select("binary_id", "library", "function", "address", "category", "severity", "summary")


def _findings(s, d):
    names = A.imports(s, d)
    words = strings.suspicious(A.strings(s, d)).withColumn("binary_id", F.concat(F.lit("Brand#"), (F.lit(10) + F.pmod("binary_id", F.lit(50))).cast("string")))
    return behavior.findings(behavior.api_insights(names), words)


def behavior_findings(s, d):
    return _findings(s, d).select("binary_id", "source", "category", "severity", "severity_rank", "detail")


def behavior_categories(s, d):
    return behavior.categories(_findings(s, d)).select("binary_id", "category", "severity", "n_findings", F.md5(F.array_join("evidence", "\n").cast("binary")).alias("evidence_md5"))


def risk_score(s, d):
    return behavior.risk(_findings(s, d))


def _operand_rows(s, d):
    """Operands that name an address in each way, and some that name none: bare digits, a doubled h, words of hex digits."""
    line = A.table(s, d, "lineitem")
    at = F.hex(F.col("l_partkey") * 4096 + F.col("l_suppkey"))
    forms = {0: ("qword ptr [", "h]"), 1: ("rax,[rip+", "h]"), 2: ("rcx,[rip-", "h]"), 3: ("rax,0x", ""), 4: ("add,dec,", ""), 5: ("rcx,[", "hh]"), 6: ("rdx,[rbx+", "]")}
    text = F.lit(None).cast("string")
    for kind, (before, after) in forms.items():
        text = F.when(F.col("l_linenumber") % 7 == kind, F.concat(F.lit(before), at, F.lit(after))).otherwise(text)
    return line.select("l_orderkey", "l_linenumber", text.alias("operands"), (F.col("l_orderkey") * 16).alias("address"), F.lit(6).alias("length"))


def hex_refs(s, d):
    return _operand_rows(s, d).select("l_orderkey", "l_linenumber", F.posexplode(X.hex_tokens(F.col("operands"))).alias("pos", "value"))


def memory_targets(s, d):
    return _operand_rows(s, d).select("l_orderkey", "l_linenumber", X.memory_target(F.col("operands"), F.col("address"), F.col("length")).alias("target"))


def instr_classes(s, d):
    return _classed(s, d).groupBy("mnemonic").agg(*[F.count_if(F.col(c)).alias(c) for c in ("is_call", "is_return", "is_conditional", "is_unconditional", "is_control_flow")])


def cfg_leaders(s, d):
    return cfg.leaders(_classed(s, d)).where("is_leader").select("binary_id", "seq", "address")


def cfg_blocks(s, d):
    return cfg.blocks(_classed(s, d))


def cfg_edges(s, d):
    return cfg.edges(_classed(s, d))


def cfg_degree(s, d):
    return cfg.degrees(cfg.edges(_classed(s, d)))


def cfg_summary(s, d):
    return instructions.cfg_summary(_members(s, d))


def function_seeds(s, d):
    return instructions.seeds(_classed(s, d), _entries(s, d))


def function_slices(s, d):
    return instructions.functions(_members(s, d)).select("binary_id", "address", "name", "size", "n_instructions", "block_estimate", "kind")


def thunks(s, d):
    """Users' streams with ``call`` read as ``jmp``, where one-instruction functions are thunks."""
    rows = A.instructions(s, d)
    c = instructions.classes(rows.withColumn("mnemonic", F.when((F.col("mnemonic") == "call") & (F.col("seq") % 2 == 0), "jmp").otherwise(F.col("mnemonic"))))
    return instructions.functions(instructions.members(c, instructions.seeds(c, _entries(s, d)))).groupBy("binary_id", "kind").agg(F.count("*").alias("n"))


def top_functions(s, d):
    return instructions.top_functions(instructions.functions(_members(s, d)), 20).select("binary_id", "address", "name")


def _calls(s, d):
    m = _members(s, d)
    return xrefs.calls(m, _no_imports(s), instructions.functions(m))


def call_refs(s, d):
    return _calls(s, d)


def call_graph(s, d):
    return xrefs.call_graph(_calls(s, d)).select("binary_id", "function_address", "target_address", "n_calls", F.array_join(F.transform("call_sites", lambda x: x.cast("string")), ",").alias("call_sites"), "target_name")


def call_graph_lineitem(s, d):
    g = xrefs.call_graph(A.calls(s, d))
    return g.select("function_address", "target_address", "n_calls", F.md5(F.array_join(F.transform("call_sites", lambda x: x.cast("string")), ",").cast("binary")).alias("sites_md5"))


def function_xrefs(s, d):
    by = xrefs.function_xrefs(instructions.functions(_members(s, d)), _calls(s, d), s.createDataFrame([], "binary_id long, function_address long, symbol string"))
    return by.select("binary_id", "address", "name", F.size("called_by").cast("long").alias("n_callers"), F.array_join(F.transform("called_by", lambda x: x["site"].cast("string")), ",").alias("sites"))


def import_xrefs(s, d):
    names = A.imports(s, d)
    sites = A.calls(s, d).select(F.col("target_address").alias("ord"), "function_address", "site")
    called = names.join(sites, "ord").select("binary_id", F.lit("import").alias("target_kind"), F.concat("library", F.lit("!"), "function").alias("target_name"), "function_address", "site")
    out = xrefs.import_xrefs(names, xrefs.import_callers(called), behavior.api_insights(names))
    return out.select("binary_id", "library", "function", "address", "category", "severity", F.size("callers").cast("long").alias("n_callers"))


def section_lookup(s, d):
    at = A.table(s, d, "events").select((F.col("user_id") * A.PLACE + F.col("event_id") % 4000).alias("address")).distinct()
    keyed = A.sections(s, d).withColumn("binary_id", F.lit(0))
    return xrefs.section_of(at.withColumn("binary_id", F.lit(0)), keyed).select("address", "section")


def section_strings(s, d):
    return strings.dedupe(strings.scan_ascii(A.sections(s, d))).select("binary_id", "section_ord", "address", "value", "length")


def param_inference(s, d):
    return instructions.parameters(_members(s, d), "PE/EXE")


def condition_ops(s, d):
    rows = cfg.previous_in_block(_classed(s, d)).where("is_conditional and previous_mnemonic = 'cmp'")
    return rows.select("binary_id", "seq", X.branch_condition(F.col("mnemonic")).alias("operator"), X.zero_condition(F.col("mnemonic")).alias("after_test"))


def identifier_sanitize(s, d):
    words = rules.C_KEYWORDS.split()
    keyword = F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words)).cast("int"))
    return A.table(s, d, "part").select("p_partkey", X.identifier(F.concat("p_name", F.lit("!"), F.col("p_brand")), "sym").alias("name"), X.file_stem(F.col("p_type")).alias("stem"), X.identifier(keyword, "sym").alias("keyword"))


def c_escape(s, d):
    return A.table(s, d, "pages").select("page_id", X.c_quote(F.col("url")).alias("quoted"), X.c_quote(F.concat(F.lit('é"\\\n\t'), F.col("page_id").cast("string"))).alias("odd"))


def runtime_markers(s, d):
    probes = s.createDataFrame([(k % 5, v) for k, v in enumerate(A.RUNTIME_PROBES)], "binary_id long, value string")
    none = s.createDataFrame([], "binary_id long, section_ord int, name string, raw binary")
    libs = s.createDataFrame([(0, "python311.dll", "Py_Main"), (7, "mscoree.dll", "_CorExeMain"), (8, "node.dll", "x")], "binary_id long, library string, function string")
    found = runtime.detect(probes.unionByName(A.strings(s, d).select("binary_id", "value")), none, libs)
    return found.select("binary_id", "family", "name", "confidence", F.array_join("evidence", "; ").alias("evidence"))


def register_map(s, d):
    return s.createDataFrame([(p,) for ps in rules.REGISTERS.values() for p in ps.split()], "part string").select("part", X.canonical_register(F.col("part")).alias("whole"))


def package_summary(s, d):
    m = written(_members(s, d), "members")
    f = instructions.functions(m)
    per = f.groupBy("binary_id").agg(F.count("*").alias("function_count"), F.sum("size").alias("code_bytes"))
    c = xrefs.calls(m, _no_imports(s), f).groupBy("binary_id").agg(F.count("*").alias("call_count"))
    b = cfg.blocks(_classed(s, d)).groupBy("binary_id").agg(F.count("*").alias("block_count"))
    return per.join(c, "binary_id", "left").join(b, "binary_id", "left").select("binary_id", "function_count", "code_bytes", F.coalesce("call_count", F.lit(0)).alias("call_count"), "block_count")


NAMES = (
    suspicious_strings, string_dedupe, decode_recipes, decode_links, api_insights, behavior_findings, behavior_categories, risk_score, hex_refs, memory_targets, instr_classes,
    cfg_leaders, cfg_blocks, cfg_edges, cfg_degree, cfg_summary, function_seeds, function_slices, thunks, top_functions, call_refs, call_graph, call_graph_lineitem, function_xrefs,
    import_xrefs, section_lookup, section_strings, param_inference, condition_ops, identifier_sanitize, c_escape, runtime_markers, register_map, package_summary,
)
QUERIES = {f.__name__: f for f in NAMES}


def decompile_functions(s, d):
    m = written(_members(s, d), "members")  # read by every branch of the plan
    f = instructions.functions(m)
    out = decompile.decompiled(m, f, xrefs.calls(m, _no_imports(s), f), instructions.parameters(m, "PE/EXE"))
    return out.select("binary_id", "address", "name", "prototype", "c_text")


QUERIES["decompile_functions"] = decompile_functions


def code_patterns(s, d):
    rows = _members(s, d).withColumn("operands", F.when(F.col("mnemonic") == "call", F.when(F.col("seq") % 2 == 0, "malloc").otherwise("free")).otherwise(F.col("operands")))
    return inference.patterns(rows).groupBy("binary_id", "pattern").agg(F.count("*").alias("n"))


def value_types(s, d):
    rows = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, (F.col("l_partkey") * F.col("l_suppkey")).cast("string")).when(F.col("l_linenumber") == 2, F.concat(F.lit("eax, 0x"), F.hex("l_orderkey"))).otherwise("rax, rbx").alias("o"))
    kind = inference.value_type(F.lit("x86"), F.when(F.col("l_linenumber") == 4, "lea").otherwise("mov"), F.col("o"))
    return rows.select("l_orderkey", "l_linenumber", kind.alias("kind")).withColumns({"c_type": inference.c_type(F.col("kind")), "size": inference.c_size(F.col("kind"))})


QUERIES |= {f.__name__: f for f in (code_patterns, value_types)}
