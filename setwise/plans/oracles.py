"""DuckDB twins of the operators, composed from named common table expressions.

``sql(final)`` puts before ``final`` the expressions it uses, in order of need. Seeds, tags and settings come
from the same ``Config`` as the Spark side.
"""

from __future__ import annotations

import re

from ..config import Config, flip_rate
from ..functions.mathx import ccdf_sql
from ..functions.prng import digest_sql, uniform_sql

#: Settings of the registered queries: small enough for md5 draws one by one, three reports a user.
CONFIG = Config(epsilon=5.0, hashes=64, max_depth=3, min_child=3)
#: Items below which a node of the static tree isn't split.
SMALLEST = 10

_s = CONFIG.seed


def _u(tag: str, *keys: str) -> str:
    return uniform_sql(_s, tag, *keys)


def _d(tag: str, *keys: str) -> str:
    return digest_sql(_s, tag, *keys)


def r6(x: str) -> str:
    return f"round({x}, 6) + 0e0"


def expressions(config: Config) -> dict[str, str]:
    """The named expressions for the settings of a build."""
    _c = config
    _q, _qh = repr(flip_rate(_c.report_epsilon)), repr(flip_rate(_c.hash_epsilon))
    out: dict[str, str] = {
        "items": "select (row_number() over (order by p_brand) - 1)::int as item, p_brand from (select distinct p_brand from part)",
        "bi": "select distinct l_orderkey as uid, item from lineitem join part on l_partkey = p_partkey join items using (p_brand)",
        "users": "select distinct uid from bi",
        "qi": "select qid, item from (select qid, item, row_number() over (partition by qid order by md5(concat_ws('|', 'q', qid, item))) as rn from items, range(1, 21) t(qid)) where rn <= 3 + qid % 10",
        "q": "select qid, (1 + qid % 3)::int as threshold, count(*)::int as asked from qi group by qid",
        "truth": "select q.qid, q.threshold, coalesce(h.hits, 0) as true_count, (select count(*) from users) as users from q left join (select qid, count(*) as hits from (select qi.qid, uid, count(*) as c from qi join bi using (item) group by qi.qid, uid) x join q using (qid) where c >= threshold group by qid) h using (qid)",
        "n_users": "select count(*) as nu from users",
        "ranked": f"select uid, row_number() over (order by {_d('cohort', 'uid')}, uid) as rank from users",
        "cohort": f"""select uid, case when i >= 0 then 'tree' else 'underlying' end as role, (case when i >= 0 then block end)::int as block_id,
          case when i >= 0 then i - base * block + 1 else rank end as pos, case when i < 0 then first_part when block < last then base else rest - base * last end as block_size
          from (select *, least(i // base, last) as block from (select uid, rank, rank - first_part - 1 as i, first_part, total - first_part as rest, greatest(1, (total - first_part) // {_c.blocks}) as base, least({_c.blocks}, greatest(total - first_part, 1)) - 1 as last
          from ranked, (select count(*) as total, floor(count(*) * {_c.alpha})::bigint as first_part from users)))""",
        "under": "select uid from cohort where role = 'underlying'",
        "item_sample": f"select uid, arg_min(item, {_d('item_sample', 'uid', 'item')}) as item from bi where uid in (select uid from under) group by uid",
        "item_bits": f"select uid, item as value, y, ({_u('item_bits', 'uid', 'y')} < case when item = y then 0.5 else {_q} end)::int as bit from item_sample, range(0, 25) t(y)",
        "item_agg": f"select y, sum(bit)::bigint as ones, count(*) as n, (sum(bit) - count(*) * {_q}) / (0.5 - {_q}) as est_count from item_bits group by y",
        "hist": "select y::int as item, case when sum(greatest(est_count, 0)) over () > 0 then greatest(est_count, 0) * n / sum(greatest(est_count, 0)) over () else 0 end as noisy_count, n from item_agg",
        "p": "select item, greatest(0, least(1, noisy_count / greatest(1, n))) as p from hist",
        "spans": f"""with recursive t(depth, lo, hi) as (select 0, 0, 25 union all
          select depth + 1, case when c = 0 then lo else lo + step end, case when c = 0 then least(lo + step, hi) else hi end
          from (select depth, lo, hi, ceil((hi - lo) / 2.0)::int as step from t where hi - lo > 2 and hi - lo >= {SMALLEST}), range(0, 2) r(c)) select * from t""",
        "numbered": "select (row_number() over (order by depth, lo) - 1)::int as node_id, depth, lo, hi from spans",
        "nodes": "select a.node_id, b.node_id as parent_id, a.depth, a.node_id as block_id, a.hi - a.lo as size, not exists (select 1 from numbered c where c.depth = a.depth + 1 and c.lo >= a.lo and c.hi <= a.hi) as is_leaf, a.lo, a.hi from numbered a left join numbered b on b.depth = a.depth - 1 and b.lo <= a.lo and b.hi >= a.hi",
        "ni": "select node_id, item, (item - lo)::int as local_id, size from nodes join items on item >= lo and item < hi",
        "nu": "select node_id, uid, pos, block_size from cohort join nodes using (block_id) where role = 'tree'",
        "nu1": "select * from nu where pos <= round_even(block_size * 0.5, 0)",
        "nu2": "select * from nu where pos > round_even(block_size * 0.5, 0)",
        "inside": "select node_id, uid, item, local_id, size from bi join nu using (uid) join ni using (node_id, item)",
        "pair_drawn": f"select node_id, uid, local_id, row_number() over (partition by node_id, uid order by {_d('pair_sample', 'node_id', 'uid', 'local_id')}) as rn from inside",
        "pair_sample": "select node_id, uid, case when count(*) = 2 then min(local_id) end as a, case when count(*) = 2 then max(local_id) end as b from pair_drawn where rn <= 2 group by node_id, uid",
        "pair_value": "select nu.node_id, uid, size, coalesce(1 + a * (size - 1) - a * (a - 1) // 2 + (b - a - 1), 0) as value from nu join nodes using (node_id) left join pair_sample using (node_id, uid)",
        "pair_bits": f"select node_id, uid, y, ({_u('pair_bits', 'node_id', 'uid', 'y')} < case when value = y then 0.5 else {_q} end)::int as bit from pair_value, unnest(range(0, 1 + size * (size - 1) // 2)) t(y)",
        "pair_agg": f"select node_id, y, (sum(bit) - count(*) * {_q}) / (0.5 - {_q}) / count(*) as f from pair_bits group by node_id, y",
        "pair_names": "select a.node_id, 1 + a.local_id * (a.size - 1) - a.local_id * (a.local_id - 1) // 2 + (b.local_id - a.local_id - 1) as y, a.local_id as a, b.local_id as b, a.item as item_a, b.item as item_b from ni a join ni b on a.node_id = b.node_id and a.local_id < b.local_id",
        "pair_freq": "select node_id, a, b, item_a, item_b, case when sum(greatest(f, 0)) over (partition by node_id) > 0 then greatest(f, 0) / sum(greatest(f, 0)) over (partition by node_id) else 0 end as freq from pair_agg left join pair_names using (node_id, y)",
        "leaves": "select node_id, item, leaf from ni join (select node_id, (row_number() over (order by node_id) - 1)::int as leaf from nodes where is_leaf) using (node_id)",
        "touched": "select distinct uid, leaf from bi join leaves using (item) where uid in (select uid from under)",
        "leaf_drawn": f"select uid, leaf, row_number() over (partition by uid order by {_d('node_pair_sample', 'uid', 'leaf')}) as rn from touched",
        "leaf_pair": "select under.uid, l, coalesce(a, l) as vi, coalesce(b, l) as vj from under left join (select uid, case when count(*) = 2 then min(leaf) end as a, case when count(*) = 2 then max(leaf) end as b from leaf_drawn where rn <= 2 group by uid) using (uid), (select count(*)::int as l from nodes where is_leaf)",
        "leaf_bits": f"select uid, i, j, ({_u('node_pair_bits', 'uid', 'i', 'j')} < case when i = vi and j = vj then 0.5 else {_q} end)::int as bit from leaf_pair, unnest(range(0, l + 1)) t(i), unnest(range(0, l + 1)) u(j)",
        "leaf_agg": f"select i, j, (sum(bit) - count(*) * {_q}) / (0.5 - {_q}) / count(*) as f from leaf_bits group by i, j",
        "leaf_smooth": "select i, j, case when sum(greatest(f, 0)) over () > 0 then greatest(f, 0) / sum(greatest(f, 0)) over () else 0 end as freq from leaf_agg",
        "cross_": "select a.node_id as node_i, b.node_id as node_j, freq from leaf_smooth join (select distinct leaf, node_id from leaves) a on i = a.leaf join (select distinct leaf, node_id from leaves) b on j = b.leaf where i < j and freq > 0",
        "held": "select nu1.node_id, uid, size, coalesce(c, 0) as value from nu1 join nodes using (node_id) left join (select node_id, uid, count(*) as c from inside group by node_id, uid) using (node_id, uid)",
        "size_bits": f"select node_id, uid, y, ({_u('size_bits', 'node_id', 'uid', 'y')} < case when value = y then 0.5 else {_q} end)::int as bit from held, unnest(range(0, size + 1)) t(y)",
        "size_agg": f"select node_id, y, count(*) as n, (sum(bit) - count(*) * {_q}) / (0.5 - {_q}) / count(*) as f from size_bits group by node_id, y",
        "oue_hist": "select node_id, y::int as k, case when sum(greatest(f, 0)) over (partition by node_id) > 0 then greatest(f, 0) / sum(greatest(f, 0)) over (partition by node_id) else 0 end as freq, n from size_agg",
        "ells": f"select unnest(range(0, {_c.hashes}))::int as ell",
        "chosen": f"select node_id, uid, ell from (select node_id, uid, ell, row_number() over (partition by node_id, uid order by {_d('hash_choice', 'node_id', 'uid', 'ell')}) as rn from nu2, ells) where rn <= {_c.hash_choices}",
        "winners": f"select node_id, uid, ell, arg_min(local_id, {_d('perm', 'ell', 'local_id')}) as winner from inside join chosen using (node_id, uid) group by node_id, uid, ell",
        "node_sig": f"select node_id, ell, arg_min(local_id, {_d('perm', 'ell', 'local_id')}) as target from ni, ells group by node_id, ell",
        "full_hits": f"select node_id, uid, sum(({_u('hash_bits', 'node_id', 'uid', 'ell', 'target')} < case when winner = target then 0.5 else {_qh} end)::int) as matches, count(*) as trials from winners join node_sig using (node_id, ell) group by node_id, uid",
        "bins": f"select node_id, uid, j, least(greatest(round_even(j * size, 0), 0), size)::int as k from (select node_id, uid, greatest(0, least(1, (matches / trials - {_qh}) / (0.5 - {_qh}))) as j from full_hits) join nodes using (node_id)",
        "mh_hist": "select node_id, k, count(*) / sum(count(*)) over (partition by node_id) as freq, (sum(count(*)) over (partition by node_id))::bigint as n from bins group by node_id, k",
        "prefix": "select node_id, item, local_id, size, row_number() over (partition by node_id order by coalesce(noisy_count, 0) desc, item) as position from ni left join hist using (item)",
        "np": "select node_id, item, local_id, size, coalesce(p, 0) as p from ni left join p using (item)",
        "pmi": "select pf.node_id, a, b, abs(ln(greatest(freq, 1e-12) / greatest(x.p * y.p, 1e-12))) as w from pair_freq pf join np x on x.node_id = pf.node_id and x.local_id = a join np y on y.node_id = pf.node_id and y.local_id = b",
        "cut_base": f"select node_id, ell, position - 1 as position, local_id, {_d('perm', 'ell', 'local_id')} as r from prefix, ells",
        "cut_sig": """select node_id, position + 1 as b, 'A' as side, ell, (min({'r': r, 'l': local_id}) over (partition by node_id, ell order by position rows unbounded preceding)).l as target from cut_base
          union all select node_id, position as b, 'B' as side, ell, (min({'r': r, 'l': local_id}) over (partition by node_id, ell order by position desc rows unbounded preceding)).l as target from cut_base""",
        "cut_hits": f"select node_id, b, side, uid, sum(({_u('hash_bits', 'node_id', 'uid', 'ell', 'target')} < case when winner = target then 0.5 else {_qh} end)::int) as matches, count(*) as trials from winners join cut_sig using (node_id, ell) group by node_id, b, side, uid",
        "shares": f"select node_id, b, side, avg((round_even(greatest(0, least(1, (matches / trials - {_qh}) / (0.5 - {_qh}))) * case when side = 'A' then b else size - b end, 0) <= 0)::int) as p0 from cut_hits join nodes using (node_id) group by node_id, b, side",
        "qn": "select q.qid, node_id, threshold, asked, count(*)::int as r, any_value(depth) as depth, any_value(nodes.size) as size, any_value(parent_id) as parent_id from q join qi using (qid) join ni using (item) join nodes using (node_id) group by q.qid, node_id, threshold, asked",
        "fulls": "select qid, arg_max(node_id, depth * 1000 - node_id) as node_id from qn where r = asked group by qid",
        "fits": "select * from qn where r >= threshold and r < asked and parent_id is not null",
        "partials": "select f.qid, f.node_id from fits f where not exists (select 1 from fits g join nodes gn on gn.node_id = g.node_id join nodes fn on fn.node_id = f.node_id where g.qid = f.qid and g.node_id <> f.node_id and gn.depth > fn.depth and gn.lo >= fn.lo and gn.hi <= fn.hi)",
        "selected": "select qid, node_id, 'full' as role from fulls union all select qid, node_id, 'partial' from partials",
        "asked_": "select role, s.node_id, s.qid, threshold, qi.item, local_id from selected s join q using (qid) join qi using (qid) join ni on ni.node_id = s.node_id and ni.item = qi.item",
        "asked_c": "select node_id, qid, threshold, count(*)::int as c from asked_ group by node_id, qid, threshold",
        "q_sig": f"select node_id, qid, ell, arg_min(local_id, {_d('perm', 'ell', 'local_id')}) as target from asked_, ells group by node_id, qid, ell",
        "q_hits": f"select node_id, qid, uid, sum(({_u('hash_bits', 'node_id', 'uid', 'ell', 'target')} < case when winner = target then 0.5 else {_qh} end)::int) as matches, count(*) as trials from winners join q_sig using (node_id, ell) group by node_id, qid, uid",
        "q_j": f"select node_id, qid, uid, greatest(0, least(1, (matches / trials - {_qh}) / (0.5 - {_qh}))) as j from q_hits",
        "alpha": "select node_id, qid, k, avg((least(greatest(case when j <= 0 then 0 else j * (k + c) / (1 + j) end, 0), least(k, c)) >= threshold)::int) as alpha from (select q_j.node_id, q_j.qid, q_j.j, bins.k, c, threshold from q_j join bins using (node_id, uid) join asked_c using (node_id, qid)) where k >= threshold group by node_id, qid, k",
        "mix_mh": "select node_id, qid, f, greatest(0, (s2 - f * f) / n) as var from (select node_id, qid, greatest(0, least(1, sum(freq * alpha))) as f, sum(freq * alpha * alpha) as s2, max(n) as n from alpha join mh_hist using (node_id, k) group by node_id, qid)",
        "mix_oue": "select node_id, qid, greatest(0, least(1, sum(freq * alpha))) as f from alpha join oue_hist using (node_id, k) group by node_id, qid",
        "n_oue": f"select node_id, max(n) as n, 4 * exp({_c.report_epsilon}) / ((exp({_c.report_epsilon}) - 1) * (exp({_c.report_epsilon}) - 1)) / max(n) as v from oue_hist group by node_id",
        "full_rows": "select a.node_id, a.qid, coalesce(m.f, 0) as fm, coalesce(m.var, 0) as vm, coalesce(o.f, 0) as fo, coalesce(v, 0) as vo from (select distinct node_id, qid from asked_ where role = 'full') a left join mix_mh m using (node_id, qid) left join mix_oue o using (node_id, qid) left join n_oue using (node_id)",
        "full_": "select node_id, qid, case when vm <= 0 then fo when vo <= 0 then fm else (vo * fm + vm * fo) / (vo + vm) end as f, case when vm <= 0 then vo when vo <= 0 then vm else vm * vo / (vm + vo) end as var from full_rows",
        "part": "select node_id, qid, threshold, item, local_id from asked_ where role = 'partial'",
    }
    # the name of a driver table is taken
    out["pasked"] = out.pop("part")
    out |= {
        "hyb_w": "select a.node_id, a.qid, (select max(n) from mh_hist h where h.node_id = a.node_id) as n, case when m.var > 0 then v / (v + m.var) else 0 end as w from (select distinct node_id, qid from pasked) a left join mix_mh m using (node_id, qid) join n_oue using (node_id)",
        "both_bins": "select coalesce(o.node_id, m.node_id) as node_id, coalesce(o.k, m.k) as k, coalesce(o.freq, 0) as o, coalesce(m.freq, 0) as m from oue_hist o full join mh_hist m on o.node_id = m.node_id and o.k = m.k",
        "hybrid": "select node_id, qid, k, n, case when sum(greatest(0, w * m + (1 - w) * o)) over (partition by node_id, qid) > 0 then greatest(0, w * m + (1 - w) * o) / sum(greatest(0, w * m + (1 - w) * o)) over (partition by node_id, qid) else 0 end as freq from hyb_w join both_bins using (node_id)",
        "inner_": "select node_id, qid, f, greatest(0, (s2 - f * f) / n) as var from (select node_id, qid, greatest(0, least(1, sum(freq * alpha))) as f, sum(freq * alpha * alpha) as s2, max(n) as n from alpha join hybrid using (node_id, qid, k) group by node_id, qid)",
        "intra": "select qid, sum(coalesce(f, 0)) as f_intra, sum(coalesce(var, 0)) as v_intra from (select distinct node_id, qid from pasked) left join inner_ using (node_id, qid) group by qid",
        "weights": "select qid, node_id, item, case when sum(coalesce(p, 0)) over w > 0 then coalesce(p, 0) / sum(coalesce(p, 0)) over w else 1 / count(*) over w end as w from pasked left join p using (item) window w as (partition by qid, node_id)",
        "crossed": "select u.qid, u.node_id as node_u, v.node_id as node_v, c.freq as p_uv, least(u.item, v.item) as item_a, greatest(u.item, v.item) as item_b, c.freq * u.w * v.w as freq from weights u join weights v on u.qid = v.qid and u.node_id < v.node_id join cross_ c on c.node_i = u.node_id and c.node_j = v.node_id",
        "couples": "select distinct qid, node_u, node_v, p_uv from crossed",
        "uni": "select qid, node_u, node_v, p_uv, threshold, item, coalesce(p, 0) as p from couples join pasked using (qid) left join p using (item) where node_id = node_u or node_id = node_v",
        "uv_pairs": "select qid, node_u, node_v, item_a, item_b, sum(freq) as freq from (select qid, node_u, node_v, item_a, item_b, freq from couples join pair_freq on node_id in (node_u, node_v) where a is not null union all select qid, node_u, node_v, item_a, item_b, freq from crossed) group by all",
        "uv_tail": "select *, (threshold - 0.5 - mu) / sqrt(var) as z from (select m.*, greatest(1e-9, v + 2 * coalesce(cov, 0)) as var from (select qid, node_u, node_v, threshold, p_uv, count(*) as n, sum(p) as mu, sum(p * (1 - p)) as v from uni group by all) m left join (select x.qid, x.node_u, x.node_v, sum(freq - x.p * y.p) as cov from uni x join uni y on x.qid = y.qid and x.node_u = y.node_u and x.node_v = y.node_v and x.item < y.item join uv_pairs g on g.qid = x.qid and g.node_u = x.node_u and g.node_v = x.node_v and g.item_a = x.item and g.item_b = y.item group by all) using (qid, node_u, node_v)) where n >= threshold",
        "cross_part": f"select qid, sum(greatest(0, least(1, t))) as f_cross, sum((t / greatest(p_uv, 1e-9)) * (t / greatest(p_uv, 1e-9)) * p_uv * (1 - p_uv) / nu) as v_cross from (select *, {ccdf_sql('z')} as t from uv_tail), n_users group by qid",
        "global_": "select qid, item_a, item_b, sum(freq) as freq from (select s.qid, item_a, item_b, freq from (select distinct qid, node_id from pasked) s join pair_freq f using (node_id) join (select distinct qid, item as item_a from pasked) using (qid, item_a) join (select distinct qid, item as item_b from pasked) using (qid, item_b) union all select qid, item_a, item_b, freq from crossed) group by all",
        "pa": "select distinct qid, threshold, item, coalesce(p, 0) as p from pasked left join p using (item)",
        "best": f"select qid, greatest(0, least(1, {ccdf_sql('z')})) as best from (select *, (threshold - 0.5 - mu) / sqrt(var) as z from (select m.*, greatest(1e-9, v + 2 * coalesce(cov, 0)) as var from (select qid, threshold, sum(p) as mu, sum(p * (1 - p)) as v from pa group by all) m left join (select x.qid, sum(freq - x.p * y.p) as cov from pa x join pa y on x.qid = y.qid and x.item < y.item join global_ g on g.qid = x.qid and g.item_a = x.item and g.item_b = y.item group by x.qid) using (qid)))",
        "parts_": "select qid, f_intra, v_intra, 0e0 as fc, 0e0 as vc, 0e0 as b from intra union all select qid, 0e0, 0e0, f_cross, v_cross, 0e0 from cross_part union all select qid, 0e0, 0e0, 0e0, 0e0, best from best",
        "partial_rows": "select qid, f_intra + fc as mean, v_intra + vc as v, greatest(0, b - f_intra - fc) as f0 from (select qid, sum(f_intra) as f_intra, sum(v_intra) as v_intra, sum(fc) as fc, sum(vc) as vc, sum(b) as b from parts_ group by qid)",
        "partial_": "select qid, greatest(0, least(1, mean + f0)) as f, case when v0 <= 0 then 1e-12 else v0 end as var from (select *, v + f0 * (1 - f0) / nu as v0 from partial_rows, n_users)",
        "final_rows": "select q.qid, q.threshold, fu.f as f_full, fu.var as var_full, pa_.f as f_partial, pa_.var as var_partial from q left join full_ fu using (qid) left join partial_ pa_ using (qid)",
        "answers_": "select qid, f_full, var_full, f_partial, var_partial, case when threshold <= 0 then 1 else greatest(0, least(1, case when coalesce(var_full, 0) <= 0 then coalesce(f_partial, f_full, 0) when coalesce(var_partial, 0) <= 0 then f_full else (var_partial * f_full + var_full * f_partial) / (var_full + var_partial) end)) end as f_hat from final_rows",
    }
    return out


def sql(final: str, config: Config = CONFIG) -> str:
    """``final`` with the expressions it needs before it."""
    ctes = expressions(config)
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in ctes and word not in seen and re.search(rf"(from|join|in \(select \w+ from|,)\s+{word}\b", text):
                seen.add(word)
                need(ctes[word])
                order.append(word)

    need(final)
    return "with " + ",\n".join(f"{name} as materialized ({ctes[name]})" for name in order) + "\n" + final
