"""Registered query of the operator on conversations' common beginnings, with its oracle SQL."""

from __future__ import annotations

from panelspark.llm import prefix_trie
from panelspark.llm.common import read_table
from panelspark.registry import query

# crc32 is folded bit by bit over the characters of the id; the prefix of a conversation is named by the digests of its turns.
_OP11_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first,
      md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, count(*) as own, conv_id - conv_id % 100 as base from t group by conv_id),
crc as (select conv_id, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], list_transform(range(8), lambda i: i::bigint)),
      lambda b, i: case when b & 1 = 1 then xor(b >> 1, 3988292384::bigint) else b >> 1 end)), 4294967295::bigint) % 6 as h from o),
c as (select o.conv_id, o.base, crc.h, least(crc.h, coalesce(b.own, 0)) as taken from o join crc using (conv_id) left join o b on b.conv_id = o.base),
r as (select c.conv_id, t.pos as d, role, text from c join t on t.conv_id = c.base and t.pos <= c.taken
  union all select c.conv_id, t.pos - c.h + c.taken, role, text from c join t on t.conv_id = c.conv_id where t.pos > c.h),
p as (select conv_id, d, length(text) as len, md5(string_agg(md5(strlen(role) || ':' || role || text), '') over (partition by conv_id order by d)) as k,
    d = max(d) over (partition by conv_id) as ends from r
  union all select conv_id, 0, 0, '', conv_id not in (select conv_id from r) from c),
n as (select d, k, min(conv_id) as conv_id, count(*) as n_convs, any_value(len) as len,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from p group by d, k),
u as (select n.*, q.k as up from n left join p q on q.conv_id = n.conv_id and q.d = n.d - 1),
ch as (select d - 1 as d, up as k, count(*) as n_children from u where d > 0 group by all),
w as (select n.*, coalesce(ch.n_children, 0) as n_children from n left join ch using (d, k)),
s as (select p.d, p.k, count(*) filter (w.n_children = 0) as n_leaves, sum((w.n_convs - 1) * w.len) as saved
  from w join p on p.conv_id = w.conv_id and p.d <= w.d group by p.d, p.k)
select w.conv_id, w.d::bigint as depth, up.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved::bigint as saved_tokens, w.ends_sha256
from w join u using (d, k) join s using (d, k) left join n up on up.d = w.d - 1 and up.k = u.up"""


@query("op11_prefix_trie", _OP11_SQL)
def op11_prefix_trie(spark, root):
    return prefix_trie.trie(read_table(spark, root, "conversations"))
