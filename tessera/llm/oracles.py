"""DuckDB SQL of the corpus queries that SQL can express."""

OP1 = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), p as (
  select r, w, unnest(range(1, greatest(len(w) - 33, 1))) as i from d
), m as (
  select r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h from p where len(w) >= 35
), t as (
  select h from m group by h having count(*) > 1
), c as (
  select distinct r, unnest(range(i, i + 35)) as k from m where h in (select h from t)
), a as (
  select r, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from d
), kept as (
  select a.r, string_agg(word, ' ' order by a.k) as s, count(*) as n from a left join c on a.r = c.r and a.k = c.k where c.r is null group by a.r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept on d.r = kept.r
"""

#: Rules, seeds, and as many rounds of both scores as settle them.
OP10 = r"""
with recursive rules(own, start, say) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), pages_ as (
  select row_number() over () as r, page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), best as (
  select r, arg_max(own || start, length(own || start)) as rule, arg_max(say, length(own || start)) as say
  from pages_ join rules on (host = own or ends_with(host, '.' || own)) and starts_with(path, start) group by r
), ruled as (
  select p.*, rule, say from pages_ p left join best using (r)
), given as (
  select host, avg(case when say = 'allow' then 1e0 else 0e0 end) as t, avg(case when say = 'block' then 1e0 else 0e0 end) as d from ruled where host <> '' group by host
), found as (
  select r, host as src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1))) as link from pages_
), named as (
  select distinct r, src, translate(regexp_extract(link, '^(?:[^/]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from found
), edges as (
  select src, dst, cast(count(*) as double) as weight from named where src <> '' and dst <> '' and src <> dst group by src, dst
), steps as (
  select src as a, dst as b, weight / sum(weight) over (partition by src) as f, 0e0 as g from edges
  union all select dst, src, 0e0, weight / sum(weight) over (partition by dst) from edges
), hosts as (
  select host, coalesce(max(case when t >= 5e-1 then t end), 0e0) as t, coalesce(max(case when d >= 5e-1 then d end), 0e0) as d
  from (select * from given union all select src, 0e0, 0e0 from edges union all select dst, 0e0, 0e0 from edges) group by host
), seeds as (
  select host, t / greatest(1e-300, sum(t) over ()) as t0, d / greatest(1e-300, sum(d) over ()) as d0 from hosts
), rank(k, host, t, d) as (
  select 0, host, t0, d0 from seeds
  union all
  select last.k + 1, s.host, 15e-2 * s.t0 + 85e-2 * coalesce(m.t, 0e0), 15e-2 * s.d0 + 85e-2 * coalesce(m.d, 0e0)
  from (select max(k) as k from rank) last cross join seeds s
  left join (select b, sum(f * rank.t) as t, sum(g * rank.d) as d from rank join steps on a = rank.host group by b) m on m.b = s.host
  where last.k < 98
), scores as (
  select host, t / greatest(1e-300, sum(t) over ()) as t, d / greatest(1e-300, sum(d) over ()) as d, count(*) over () as n from rank where k = 98
)
select page_id, ruled.host as host, path, rule, coalesce(say, case when s.d * s.n > 2e0 and s.d > s.t then 'block' end, 'allow') as verdict
from ruled left join scores s on ruled.host = s.host
"""

SQL = {"op1_substrings": OP1, "op10_links": OP10}
