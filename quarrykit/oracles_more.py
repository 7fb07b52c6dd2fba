"""SQL of ``queries_more``, of parameters and of runtimes, over the same tables, written apart from the operators."""

from __future__ import annotations

from quarrykit import rules
from quarrykit.oracles import FINDINGS, IMPORTS, INSTR, STRINGS, _lower, _quoted, _values
from quarrykit.plans import adapters as A

JUMPS = (
    INSTR.replace("else 'ret' end m,", "else 'ret' end m0,")
    .replace("::bigint k from events),", "::bigint k from events), ev1 as (select *, case when m0 = 'call' and seq % 2 = 0 then 'jmp' else m0 end m from ev),", 1)
    .replace("from ev a left join ev b", "from ev1 a left join ev1 b")
    .replace("case when a.m in ('jne', 'call')", "case when a.m0 in ('jne', 'call')")
    .replace("a.m in ('call', 'ret', 'jne') is_cf", "a.m in ('call', 'ret', 'jne', 'jmp') is_cf")
    .replace(
        "select distinct binary_id, target address from ins where is_call and target is not null",
        "select distinct binary_id, target address from (select *, lead(address) over (partition by binary_id order by seq) na from ins) where target is not null and (is_call or (m = 'jmp' and target = na and na <> address + length))",
    )
)
REFS = f"""{INSTR}, refs as (select binary_id, f function_address, address site, 4096 + 16 * k string_address, 'str_' || to_hex(4096 + 16 * k) symbol, 's' || k as value from mem where m = 'mov' and k % 4 in (0, 1) and k % 3 <> 0)"""
_ARM = ("b.eq", "bne", "cbz", "bl", "ret", "b", "ldr", "b.xy", "blx", "tbnz", "eret", "bx")
ARM = f"""{INSTR.split("ins as (")[0].rstrip().rstrip(",")},
arm as (select binary_id, seq, address, ([{", ".join(map(_quoted, _ARM))}])[k % 12 + 1] m, case when seq % 4 = 3 then null else k % 50 * 16 + address - address % 800 end target from ev),
ins as (select *, m in ('b.eq', 'bne', 'cbz', 'b.xy', 'tbnz') is_cond, m in ('bl', 'blx') is_call, m in ('ret', 'eret') is_ret, m in ('b', 'bx') is_un, m not in ('bne', 'ldr') is_cf from arm),
lead as (select i.*, coalesce(lag(is_cf) over (partition by binary_id order by seq), true) or exists (select 1 from ins j where j.binary_id = i.binary_id and j.is_cf and j.target = i.address) is_leader from ins i),
blk as (select *, sum(is_leader::int) over (partition by binary_id order by seq rows unbounded preceding) - 1 block_id from lead),
blocks as (select binary_id, block_id::bigint block_id, arg_min(address, seq) address, min(seq) first_seq, max(seq) last_seq, count(*) n_instructions, arg_max(m, seq) lm, arg_max(coalesce(target, -1), seq) lt from blk group by 1, 2),
nx as (select *, lead(block_id) over (partition by binary_id order by block_id) nb, lm in ('b.eq', 'bne', 'cbz', 'b.xy', 'tbnz') c, lm in ('b', 'bx') u, lm in ('bl', 'blx') l, lm in ('ret', 'eret') r from blocks),
edges as (
  select a.binary_id, a.block_id src_block, b.block_id dst_block, case when c then 'BranchTrue' when u then 'Unconditional' else 'Call' end edge_type from nx a join blocks b on b.binary_id = a.binary_id and b.address = a.lt where c or u or l
  union all select binary_id, block_id, nb, case when c then 'BranchFalse' else 'FallThrough' end from nx where nb is not null and not u and not r)
"""
MARKERS = f"""mk(f, o, kind, n, label) as (values {_values(rules.RUNTIME_MARKERS)}), fam(f, name, guidance) as (values {_values(rules.RUNTIME_FAMILIES)}),
hit as (select distinct b, mk.f, o, n, label from texts join mk on mk.kind = texts.kind and contains({_lower("v")}, lower(n))),
det as (select b binary_id, f, list(label order by o) e from hit group by 1, 2 having not bool_and(f = 'dotnet_clr' and n = '#~'))
"""
PROBES = f"select k % 5 b, 'string' kind, v from (values {_values(enumerate(A.RUNTIME_PROBES))}) t(k, v)"
STARTS = [a for a, prefixes in rules.PROLOGUES.items() for _ in prefixes]

ORACLES = {
    "string_xrefs": f"with {REFS} select * from refs",
    "strings_by_function": f"with {REFS} select binary_id, function_address, string_agg(distinct symbol, ',' order by symbol) symbols, count(*) n_refs from refs group by 1, 2",
    "tail_calls": f"with {JUMPS} select m.binary_id, m.f function_address, m.address site, m.target target_address, 'function' target_kind, fun.name target_name from mem m left join fun on fun.binary_id = m.binary_id and fun.address = m.target where m.m = 'jmp' and m.target is not null",
    "block_estimate": f"with {JUMPS} select binary_id, f address, (1 + count(*) filter (is_call or is_cond or m = 'jmp'))::bigint block_estimate from mem group by 1, 2",
    "jump_tables": f"with {INSTR} select binary_id, address, 'qword ptr [rax*8+' || to_hex(address) || 'h]' operands from ev where m = 'call' and seq % 6 = 0",
    "export_names": f"""with {INSTR}, e0 as (select user_id binary_id, event_id * 16 address, event_id ord, case when event_id % 2 = 0 then 'f' || event_id else '' end as name from events where event_id % 3 = 0 and event_id <> 0),
 ex as (select * from e0 union all select binary_id, address, ord - 1, 'early_' || name from e0 where ord % 4 = 0),
 nm as (select binary_id, address, arg_min(name, ord) filter (name <> '') nm from ex group by 1, 2),
 s2 as (select binary_id, address from seeds union select binary_id, address from ex),
 m2 as (select * from (select i.*, last_value(s.address ignore nulls) over (partition by i.binary_id order by seq rows unbounded preceding) f from ins i left join s2 s on s.binary_id = i.binary_id and s.address = i.address) where f is not null),
 f2 as (select binary_id, f address, count(*) n_instructions from m2 group by 1, 2)
 select f2.binary_id, f2.address, coalesce(nm.nm, 'sub_' || to_hex(f2.address)) as name, nm.address is not null is_export, n_instructions from f2 left join nm on nm.binary_id = f2.binary_id and nm.address = f2.address""",
    "arm_classes": f"with {ARM} select m mnemonic, count(*) filter (is_call) is_call, count(*) filter (is_ret) is_return, count(*) filter (is_cond) is_conditional, count(*) filter (is_un) is_unconditional, count(*) filter (is_cf) is_control_flow from ins group by 1",
    "arm_blocks": f"with {ARM} select binary_id, block_id, address, first_seq, last_seq, n_instructions from blocks",
    "arm_edges": f"with {ARM} select binary_id, src_block, dst_block, edge_type from edges",
    "runtime_confidence": f"""with texts as ({PROBES} union all select p_partkey, 'import', ([{", ".join(map(_quoted, A.RUNTIME_LIBRARIES))}])[p_partkey % {len(A.RUNTIME_LIBRARIES)} + 1] from part), {MARKERS}
 select binary_id, f family, least(95, 60 + 15 * (len(e) - 1))::int confidence, len(e)::int n_evidence from det""",
    "runtime_markers": f"""with {STRINGS}, texts as ({PROBES} union all select binary_id, 'string', v from a_strings union all select * from (values (0, 'import', 'python311.dll'), (0, 'function', 'Py_Main'), (7, 'import', 'mscoree.dll'), (7, 'function', '_CorExeMain'), (8, 'import', 'node.dll')) t), {MARKERS}
 select binary_id, det.f family, fam.name, least(95, 60 + 15 * (len(e) - 1))::int confidence, array_to_string(e, '; ') evidence from det join fam on fam.f = det.f""",
    "finding_ranks": f"with {FINDINGS} select binary_id, source, category, severity, detail, row_number() over (partition by binary_id order by r desc, category, detail, source) place from fr",
    "string_symbols": "select l_orderkey, l_linenumber, 'str_' || upper(printf('%x', (l_orderkey * 68719476736 + l_partkey) * case when l_linenumber % 2 = 0 then -1 else 1 end)) symbol from lineitem",
    "stack_slots": """select l_orderkey, l_linenumber, case when l_linenumber <= 3 then case when x < 0 then 'local_' else 'arg_' end || lower(to_hex(abs(x))) when l_linenumber <= 6 then case when x < 0 then 'stack_m_' else 'stack_' end || lower(to_hex(abs(x))) end slot
 from (select *, (l_partkey - l_suppkey * 20)::bigint x from lineitem)""",
    "integer_literals": "select l_orderkey, l_linenumber, case l_linenumber when 1 then n when 2 then -n when 3 then n when 4 then -n when 5 then n end as value from (select *, l_partkey * l_suppkey n from lineitem)",
    "comment_sanitize": "select page_id, md5(replace(replace(html, '<', '*/'), '*/', '* /')) comment_md5 from pages",
    "contains_any_case": f"select doc_id, contains(t, 'the') has_the, contains(t, 'en') has_en from (select doc_id, {_lower("coalesce(text, '')")} t from documents)",
    "format_names": """select doc_id, case doc_id % 10 when 0 then 'PE/EXE' when 1 then 'ELF' when 7 then case when starts_with(text, 'F') then 'ELF' end when 8 then case when starts_with(text, 'Z') then 'PE/EXE' end
 when 9 then case when starts_with(text, 'MZ') then 'PE/EXE' end else 'Mach-O' end format from documents""",
    "prologues": f"select event_id, ([{', '.join(map(_quoted, STARTS))}])[event_id % {len(STARTS)} + 1] = ([{', '.join(map(_quoted, rules.PROLOGUES))}])[user_id % {len(rules.PROLOGUES)} + 1] is_prologue from events",
    "artifact_files": """select binary_id, ord, b || case when n > 1 then '_' || n else '' end || '.pyc' file_name from (select p_size binary_id, p_partkey ord, b, row_number() over (partition by p_size, b order by p_partkey) n
 from (select *, regexp_replace(array_to_string(string_split(p_type, ' ')[1:2], ' '), '[^A-Za-z0-9_.-]', '_', 'g') b from part))""",
    "import_declarations": f"with {IMPORTS} select binary_id, ord, fn as function, address, fn || case when n > 1 then '_' || n else '' end c_name from (select *, row_number() over (partition by binary_id, fn order by ord) n from a_imports)",
    "param_inference": f"""with {INSTR}, f as (select *, row_number() over (partition by binary_id, f order by seq) i, max((m in ('call', 'ret'))::int) over (partition by binary_id, f order by seq rows unbounded preceding) stop from mem),
 r as (select binary_id, f, i, case m when 'mov' then k % 4 else case when k % 4 < 2 then 4 else 5 end end form from f where i <= 32 and stop = 0 and m in ('mov', 'cmp')),
 how(form, reg, rd) as (values (0, 'rcx', true), (1, 'rcx', false), (2, 'rdx', true), (3, 'r8', false), (3, 'rcx', true), (4, 'rdx', true), (5, 'r9', true)),
 u as (select binary_id, f, reg, min(i) filter (rd) a, min(i) filter (not rd) b from r join how on how.form = r.form group by 1, 2, 3)
 select binary_id, f function_address, string_agg(reg, ',' order by list_position(['rcx', 'rdx', 'r8', 'r9'], reg)) parameters from u where a is not null and (b is null or a <= b) group by 1, 2""",
}
