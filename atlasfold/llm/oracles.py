"""DuckDB SQL for the queries that SQL can express."""

#: n-grams of document words joined to the windows of benchmark items, one width at a time.
OP1 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
p as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
      from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
x as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from p) where len(w) >= n)),
h as (select x.doc_id, x.i, x.n, p.item_id from x join p on x.g = p.g and x.n = p.n),
c as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from (select distinct doc_id, i, n from h)) group by 1),
e as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (doc_id) left join e using (doc_id)
"""

OP6 = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
m as (select d, max(page_id) keep from p where n >= 1000 group by 1)
select page_id, n::bigint payload_bytes, d payload_digest, case when n >= 1000 and page_id <> keep then 'revisit' else 'response' end record_type,
       case when n >= 1000 and page_id <> keep then keep end refers_to
from p left join m using (d)
"""

OP8 = r"""
with u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then url[strpos(url, '://') + 3 :] else '' end r from pages),
h as (select page_id, r, regexp_extract(r, '^[^/?#]*') raw from u),
s as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r[len(raw) + 1 :], '^[^?#]*') path from h),
rules(v, rh, rp) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit as (select page_id, max_by(rh || rp, len(rh || rp)) rule, max_by(v, len(rh || rp)) v from s join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1),
l as (select host from s join fit using (page_id) where host <> '' group by 1 having sum(case v when 'block' then 1 else -1 end) > 0)
select page_id, host, path, rule, coalesce(v, case when host in (select host from l) then 'block' else 'allow' end) verdict
from s left join fit using (page_id)
"""

OP11 = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents where text is not null),
g as (select count(*) n_docs, sum(len(w))::hugeint n_terms from d where len(w) > 0),
b as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark where text is not null),
p as (select doc_id, t, count(*) tf from (select doc_id, unnest(w) t from d) where t in (select t from b) group by all),
f as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint weight from (select t, count(*) df from p group by 1), g),
m as (select doc_id, 25 + (75 * len(w) * n_docs) // n_terms m from d, g where len(w) > 0),
s as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from b join p using (t) join f using (t) join m using (doc_id) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""

OP13 = r"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () i,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
t as (select lang, source, i, unnest(w) term from d),
k as (select lang, term, count(*)::hugeint n from t group by 1, 2 having count(distinct i) >= 3),
v as (select lang, count(*) v, sum(n) n from k group by 1),
g as (select lang, source from d group by 1, 2),
c as (select lang, source, term, count(*)::hugeint c from t join k using (lang, term) group by 1, 2, 3),
n as (select lang, source, coalesce(sum(c), 0) n from g left join c using (lang, source) group by 1, 2),
p as (select g.lang, g.source, k.term, 1 + (1000000000 * (coalesce(c, 0) + 1)) // (n.n + v.v) p, coalesce(c, 0) c, 1 + (1000000000 * (k.n + 1)) // (v.n + v.v) q
      from g join k using (lang) join n on n.lang = g.lang and n.source = g.source join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
x as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' part, term item, (((p - q) * (p - q)) // q)::bigint value from p where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 200
"""

SQL = {"op1_decontaminate": OP1, "op6_warc": OP6, "op8_url_filter": OP8, "op11_ranking": OP11, "op13_divergence": OP13}
