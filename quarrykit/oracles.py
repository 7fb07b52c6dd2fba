"""SQL for the queries, over the same tables, written apart from the operators."""

from __future__ import annotations

from quarrykit import rules
from quarrykit.plans import adapters as A


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


P = A.PLACE
STRINGS = rf"""
toks as (select doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') w from documents),
a_strings as (
  select doc_id binary_id, doc_id * {P} + i - 1 address, w[i] v from toks, unnest(range(1, len(w) + 1)) u(i)
  union all select page_id, page_id * {P} + {P - 1}, url from pages
  union all select -1, k, v from (values {_values(enumerate(A.ENCODED))}) t(k, v)),
sus as (select *, case when l like 'http://%' or l like 'https://%' then 'url'
  when contains(l, 'powershell') or contains(l, 'cmd.exe') or contains(l, '/bin/sh') or contains(l, 'curl ') or contains(l, 'wget ') then 'command'
  when contains(l, 'password') or contains(l, 'passwd') or contains(l, 'token') or contains(l, 'apikey') or contains(l, 'api_key') or contains(l, 'secret') then 'credential_hint'
  when ends_with(l, '.dll') or ends_with(l, '.exe') or ends_with(l, '.sys') or contains(l, '\software\') then 'platform_indicator' end category
  from (select *, {_lower("v")} l, 'str_' || to_hex(address) symbol from a_strings)),
rec as (select *, case when t = '' then null
  when len(regexp_extract_all(replace(t, '%', '%%'), '%[0-9A-Fa-f][0-9A-Fa-f]')) >= 2 then 'url_percent_encoding'
  when regexp_full_match(c, '[0-9A-Fa-f]{{16,}}') and length(c) % 2 = 0 and regexp_matches(c, '[A-Fa-f]') then 'hex'
  when length(t) >= 16 and length(t) % 4 = 0 and (regexp_full_match(t, '[A-Za-z0-9+/]+={{0,2}}') or (regexp_matches(t, '[-_]') and regexp_full_match(t, '[A-Za-z0-9_-]+={{0,2}}'))) and not regexp_full_match(t, '[0-9A-Fa-f]+') then 'base64'
  when len(regexp_extract_all(t, '\\[xX][0-9A-Fa-f][0-9A-Fa-f]')) >= 2 then 'escaped_hex' end signal
  from (select *, regexp_replace(t, '[ \t\n\f\r:_-]', '', 'g') c from (select *, regexp_replace(v, '^\s+|\s+$', '', 'g') t, 'str_' || to_hex(address) symbol from a_strings))),
recs as (select *, case signal when 'url_percent_encoding' then 85 when 'hex' then 80 when 'escaped_hex' then 75 else case when t like 'H4sI%' then 90 when t like 'eJ%' or t like '%=' then 85 else 70 end end confidence,
  case signal when 'url_percent_encoding' then 'contains repeated %HH escape sequences' when 'hex' then 'long even-length hexadecimal string' when 'escaped_hex' then 'contains repeated \xHH byte escapes'
   else case when t like 'H4sI%' then 'base64 text starts with a common gzip marker' when t like 'eJ%' then 'base64 text starts with a common zlib marker' else 'long padded base64-looking string' end end reason,
  case signal when 'url_percent_encoding' then '[{{"op":"URL Decode","args":[true]}}]' when 'hex' then '[{{"op":"From Hex","args":["Auto"]}}]' when 'escaped_hex' then '[{{"op":"Unescape string","args":[]}}]'
   else '[{{"op":"From Base64","args":["' || case when regexp_matches(t, '[-_]') then 'A-Za-z0-9-_=' else 'A-Za-z0-9+/=' end || '",true,false]}}'
    || case when t like 'H4sI%' then ',{{"op":"Gunzip","args":[]}}' when t like 'eJ%' then ',{{"op":"Zlib Inflate","args":[0,0,"Adaptive",false,false]}}' else '' end || ']' end recipe
  from rec where signal is not null)
"""
_API = []
_seen = set()
for _k, (_category, _severity, _summary, _words) in enumerate(rules.API_RULES):
    for _w in _words.split():
        for _e in rules.API_SUFFIXES:
            if _w + _e not in _seen:
                _seen.add(_w + _e)
                _API.append((_w + _e, _category, _severity, _summary))
IMPORTS = f"""
a_imports as (select p_brand binary_id, p_brand library, ([{", ".join(map(_quoted, A.API_NAMES))}])[p_partkey % {len(A.API_NAMES)} + 1] || ([{", ".join(map(_quoted, A.API_ENDINGS))}])[p_partkey % {len(A.API_ENDINGS)} + 1] fn, p_partkey * 8 address, p_partkey ord from part),
api(k, category, severity, summary) as (values {_values(_API)}),
ins as (select i.*, api.* from a_imports i join api on api.k = {_lower("i.fn")})
"""
RANK = "case {0} when 'high' then 3 when 'medium' then 2 when 'low' then 1 end"
FINDINGS = f"""{STRINGS}, {IMPORTS},
fin as (select binary_id, 'import_table' source, category, severity, library || '!' || fn || ' - ' || summary detail from ins
  union all select 'Brand#' || (10 + ((binary_id % 50) + 50) % 50), 'string', case category when 'url' then 'network' when 'command' then 'process_execution' when 'credential_hint' then 'credential_access' else 'filesystem' end,
   case category when 'platform_indicator' then 'low' else 'medium' end, symbol || ' @ 0x' || to_hex(address) || ': ' || v from sus where category is not null),
fr as (select *, {RANK.format("severity")} r from fin)
"""
INSTR = """
ev as (select user_id binary_id, row_number() over (partition by user_id order by ts, event_id) seq, count(*) over (partition by user_id) n, event_id * 16 address, (1 + event_id % 15)::int length,
  case event_type when 'view' then 'mov' when 'click' then 'cmp' when 'error' then 'jne' when 'purchase' then 'call' else 'ret' end m, json_extract(props, '$.k')::bigint k from events),
ins as (select a.*, b.address target, a.m = 'call' is_call, a.m = 'ret' is_ret, a.m = 'jne' is_cond, a.m in ('call', 'ret', 'jne') is_cf from ev a left join ev b on b.binary_id = a.binary_id and b.seq = case when a.m in ('jne', 'call') then 1 + a.k % a.n end),
lead as (select i.*, coalesce(lag(is_cf) over (partition by binary_id order by seq), true) or exists (select 1 from ins j where j.binary_id = i.binary_id and j.is_cf and j.target = i.address) is_leader from ins i),
blk as (select *, sum(is_leader::int) over (partition by binary_id order by seq rows unbounded preceding) - 1 block_id from lead),
blocks as (select binary_id, block_id::bigint block_id, arg_min(address, seq) address, min(seq) first_seq, max(seq) last_seq, count(*) n_instructions, arg_max(m, seq) lm, arg_max(coalesce(target, -1), seq) lt from blk group by 1, 2),
nx as (select *, lead(block_id) over (partition by binary_id order by block_id) nb from blocks),
edges as (
  select a.binary_id, a.block_id src_block, b.block_id dst_block, case a.lm when 'jne' then 'BranchTrue' else 'Call' end edge_type from nx a join blocks b on b.binary_id = a.binary_id and b.address = a.lt where a.lm in ('jne', 'call')
  union all select binary_id, block_id, nb, case lm when 'jne' then 'BranchFalse' else 'FallThrough' end from nx where lm <> 'ret' and nb is not null),
seeds as (select distinct binary_id, target address from ins where is_call and target is not null union select binary_id, arg_min(address, seq) from ins group by 1 having arg_min(address, seq) <> 0),
mem as (select * from (select i.*, last_value(s.address ignore nulls) over (partition by i.binary_id order by seq rows unbounded preceding) f from ins i left join seeds s on s.binary_id = i.binary_id and s.address = i.address) where f is not null),
fun as (select binary_id, f address, 'sub_' || to_hex(f) as name, sum(length)::bigint size, count(*) n_instructions, (1 + count(*) filter (is_call or is_cond))::bigint block_estimate from mem group by 1, 2),
calls as (select m.binary_id, m.f function_address, m.address site, m.target target_address, 'function' target_kind, fun.name target_name from mem m left join fun on fun.binary_id = m.binary_id and fun.address = m.target where m.is_call and m.target is not null)
"""
LINE = """
op as (select l_orderkey, l_linenumber, l_linenumber % 7 kind, l_partkey * 4096 + l_suppkey x, l_orderkey * 16 a from lineitem)
"""

ORACLES = {
    "suspicious_strings": f"with {STRINGS} select binary_id, address, symbol, v as value, category from sus where category is not null",
    "string_dedupe": f"with {STRINGS} select binary_id, v as value, min(address) address from a_strings where binary_id >= 0 group by 1, 2",
    "decode_recipes": f"with {STRINGS} select binary_id, address, symbol, v as value, signal, confidence::int confidence, reason from recs",
    "decode_links": f"with {STRINGS} select binary_id, address, recipe, '{rules.LINK_BASE}' || url_encode(recipe) || '&input=' || url_encode(base64(encode(v))) deep_link from recs",
    "api_insights": f"with {IMPORTS} select binary_id, library, fn as function, address, category, severity, summary from ins",
    "behavior_findings": f"with {FINDINGS} select binary_id, source, category, severity, r::int severity_rank, detail from fr",
    "behavior_categories": f"with {FINDINGS} select binary_id, category, case max(r) when 3 then 'high' when 2 then 'medium' else 'low' end severity, count(*) n_findings, md5(string_agg(detail, chr(10) order by r desc, detail)) evidence_md5 from fr group by 1, 2",
    "risk_score": f"""with {FINDINGS}, c as (select binary_id, category, max(r) r, count(*) filter (source = 'string') s from fr group by 1, 2),
 b as (select binary_id, least(sum(case r when 3 then 35 when 2 then 8 else 2 end) + 2 * least(sum(s), 4), case when max(r) = 3 then 100 else 69 end) score from c group by 1)
 select binary_id, score::int score, case when score >= 70 then 'high' when score >= 25 then 'medium' when score >= 1 then 'low' else 'none' end as level from b""",
    "hex_refs": f"""with {LINE} select l_orderkey, l_linenumber, 0::int pos, x as value from op where kind < 4""",
    "memory_targets": f"with {LINE} select l_orderkey, l_linenumber, case kind when 0 then x when 1 then a + 6 + x when 2 then a + 6 - x end target from op",
    "instr_classes": f"with {INSTR} select m mnemonic, count(*) filter (is_call) is_call, count(*) filter (is_ret) is_return, count(*) filter (is_cond) is_conditional, 0::bigint is_unconditional, count(*) filter (is_cf) is_control_flow from ins group by 1",
    "cfg_leaders": f"with {INSTR} select binary_id, seq, address from lead where is_leader",
    "cfg_blocks": f"with {INSTR} select binary_id, block_id, address, first_seq, last_seq, n_instructions from blocks",
    "cfg_edges": f"with {INSTR} select binary_id, src_block, dst_block, edge_type from edges",
    "cfg_degree": f"with {INSTR}, e as (select binary_id, src_block b, 1 o, 0 i from edges union all select binary_id, dst_block, 0, 1 from edges) select binary_id, b block_id, sum(o)::bigint n_successors, sum(i)::bigint n_predecessors from e group by 1, 2",
    "cfg_summary": f"with {INSTR} select binary_id, count(*) filter (is_call) direct_calls, count(*) filter (is_cond) conditional_branches, 0::bigint unconditional_branches, count(*) filter (is_ret) returns from mem group by 1",
    "function_seeds": f"with {INSTR} select binary_id, address from seeds",
    "function_slices": f"with {INSTR} select *, 'normal' kind from fun",
    "top_functions": f"with {INSTR} select binary_id, address, name from fun qualify row_number() over (partition by binary_id order by address) <= 20",
    "call_refs": f"with {INSTR} select * from calls",
    "call_graph": f"with {INSTR} select binary_id, function_address, target_address, count(*) n_calls, string_agg(site::varchar, ',' order by site) call_sites, arg_min(target_name, site) target_name from calls group by 1, 2, 3",
    "call_graph_lineitem": "select l_suppkey function_address, l_partkey target_address, count(*) n_calls, md5(string_agg((l_orderkey * 8 + l_linenumber)::varchar, ',' order by l_orderkey * 8 + l_linenumber)) sites_md5 from lineitem group by 1, 2",
    "function_xrefs": f"with {INSTR} select fun.binary_id, fun.address, fun.name, count(c.site) n_callers, coalesce(string_agg(c.site::varchar, ',' order by c.function_address, c.site), '') sites from fun left join calls c on c.binary_id = fun.binary_id and c.target_address = fun.address group by 1, 2, 3",
    "import_xrefs": f"""with {IMPORTS}, c as (select binary_id, {_lower("library")} lk, {_lower("fn")} fk, count(*) n from a_imports join lineitem on l_partkey = ord group by 1, 2, 3)
 select i.binary_id, i.library, i.fn as function, i.address, api.category, api.severity, coalesce(c.n, 0)::bigint n_callers from a_imports i left join api on api.k = {_lower("i.fn")} left join c on c.binary_id = i.binary_id and c.lk = {_lower("i.library")} and c.fk = {_lower("i.fn")}""",
    "section_lookup": f"""with spots as (select distinct user_id * {P} + event_id % 4000 a from events), s as (select doc_id, doc_id * {P} va, greatest(strlen(text), 1) n from documents)
 select a address, arg_min('s' || doc_id, doc_id) as section from spots join s on a >= va and a < va + n group by 1""",
    "section_strings": rf"""with s as (select d.source, d.doc_id, string_split(replace(d.text, chr(10), chr(1)), chr(1)) w, encode(d.text) b from documents d join labels l on l.doc_id = d.doc_id and l.quality = 1),
 p as (select source, doc_id, i, w[i] seg, sum(strlen(w[i]) + 1) over (partition by source, doc_id order by i) - 1 e from s, unnest(range(1, len(w))) u(i)),
 r as (select *, regexp_extract(seg, '[\x20-\x7E]*$') v from p)
 select source binary_id, doc_id section_ord, min(doc_id * {P} + e - length(v))::bigint address, v as value, length(v) length from r where length(v) between 4 and 1024 group by 1, 2, 4, 5""",
    "condition_ops": f"with {INSTR}, p as (select *, lag(m) over (partition by binary_id, block_id order by seq) pm from blk) select binary_id, seq, '!=' as operator, '!=' after_test from p where is_cond and pm = 'cmp'",
    "package_summary": f"""with {INSTR}, c as (select binary_id, count(*) n from calls group by 1), b as (select binary_id, count(*) n from blocks group by 1)
 select f.binary_id, count(*) function_count, sum(size)::bigint code_bytes, coalesce(any_value(c.n), 0) call_count, any_value(b.n) block_count from fun f left join c on c.binary_id = f.binary_id left join b on b.binary_id = f.binary_id group by 1""",
    "register_map": "select * from (values " + _values((p, w) for w, ps in rules.REGISTERS.items() for p in ps.split()) + ") t(part, whole)",
    "c_escape": r"""select page_id, '"' || url || '"' quoted, '"\303\251\"\\\n\t' || page_id || '"' odd from pages""",
    "identifier_sanitize": rf"""select p_partkey, case when regexp_matches(b, '^[0-9]') then 'sym_' || b else b end as name, regexp_replace(p_type, '[^A-Za-z0-9_.-]', '_', 'g') stem,
  case when starts_with(k, '_') then 'sym_' || ltrim(k, '_') || '_' else k || '_' end keyword
 from (select *, regexp_replace(regexp_replace(p_name || '!' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_$', '') b, ([{", ".join(map(_quoted, rules.C_KEYWORDS.split()))}])[p_partkey % {len(rules.C_KEYWORDS.split())} + 1] k from part)""",
    "thunks": f"""with {INSTR.replace("else 'ret' end m,", "else 'ret' end m0,").replace("::bigint k from events),", "::bigint k from events), ev1 as (select *, case when m0 = 'call' and seq % 2 = 0 then 'jmp' else m0 end m from ev),", 1).replace("from ev a left join ev b", "from ev1 a left join ev1 b").replace("case when a.m in ('jne', 'call')", "case when a.m0 in ('jne', 'call')").replace("a.m in ('call', 'ret', 'jne') is_cf", "true is_cf").replace("select distinct binary_id, target address from ins where is_call and target is not null", "select distinct binary_id, target address from (select *, lead(address) over (partition by binary_id order by seq) na from ins) where target is not null and (is_call or (m = 'jmp' and target = na and na <> address + length))")}
 select binary_id, kind, count(*) n from (select binary_id, f, case when count(*) = 1 and bool_and(m = 'jmp') then 'tailcall_thunk' else 'normal' end kind from mem group by 1, 2) group by 1, 2""",
    "code_patterns": f"""with {INSTR}, ops as (select *, case m when 'call' then case when seq % 2 = 0 then 'call malloc' else 'call free' end when 'mov' then case k % 4 when 0 then 'mov rax,rcx' when 1 then 'mov ecx,5' when 2 then 'mov [rbp-8],rdx' else 'mov r8,[rcx]' end when 'cmp' then case when k % 4 < 2 then 'cmp rdx,0' else 'cmp eax,r9d' end else m end t from mem),
 fn as (select binary_id, f, string_agg(t, '; ' order by seq) t from ops group by 1, 2),
 hit as (select binary_id, 'malloc_call' as pattern from fn where regexp_matches(t, 'call.*malloc') union all select binary_id, 'free_call' from fn where regexp_matches(t, 'call.*free') union all select binary_id, 'while_loop' from fn where regexp_matches(t, 'cmp.*;\\s*j[nelg|]'))
 select binary_id, pattern, count(*) n from hit group by 1, 2""",
    "value_types": """with v as (select l_orderkey, l_linenumber, case l_linenumber when 1 then l_partkey * l_suppkey when 2 then l_orderkey end x from lineitem),
 k as (select l_orderkey, l_linenumber, case when x is not null then case when x <= 255 then 'U8' when x <= 65535 then 'U16' when x <= 4294967295 then 'U32' else 'U64' end when l_linenumber = 4 then 'Pointer(Void)' else 'Unknown' end kind from v)
 select *, case kind when 'U8' then 'uint8_t' when 'U16' then 'uint16_t' when 'U32' then 'uint32_t' when 'U64' then 'uint64_t' else 'void*' end c_type, case kind when 'U8' then 1 when 'U16' then 2 when 'U32' then 4 else 8 end::int size from k""",
}
