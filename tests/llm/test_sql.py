"""Parts of the operators that SQL can express, against DuckDB on the same whole tables."""

import duckdb

from haltbook.llm import quality, simhash, urls

AT = "/root/testdata/sf0.01"

HOSTS = r"""with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
 rules as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, v)),
 best as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as given from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, rules.p) group by page_id)
 select page_id, host, path, rule, given from p left join best using (page_id)"""

COUNTS = r"""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, coalesce(text, '') as t from documents),
 s as (select doc_id, i, w[i:i + 4] as five from w, range(1, len(w) - 3) r(i)),
 twice as (select doc_id, i, count(*) over (partition by doc_id, five) > 1 as again from s),
 hit as (select distinct doc_id, i + k as at from twice, range(0, 5) r(k) where again),
 n as (select doc_id, count(*) as n_repeat_words from hit group by 1),
 l as (select doc_id, unnest(string_split(t, chr(10))) as line from w),
 d as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1)
 select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(w) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(w) as base_failed
 from w left join n using (doc_id) left join d using (doc_id)"""


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_url_parts_and_rules(spark):
    got = urls.filter_urls(spark.read.parquet(f"{AT}/pages.parquet")).collect()
    want = {r[0]: r[1:] for r in duck(HOSTS)}
    assert len(got) == len(want)
    for r in got:
        host, path, rule, given = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (given is None or r.verdict == given)


def test_quality_counts(spark):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.judge(spark.read.parquet(f"{AT}/documents.parquet")).select(*columns).collect()
    assert sorted(map(tuple, got)) == duck(COUNTS)


def test_components_by_sql(spark):
    """Components of the fingerprints by a recursive query over all pairs within 3 bits."""
    found = simhash.near_duplicates(spark.read.parquet(f"{AT}/documents.parquet")).collect()
    con = duckdb.connect()
    con.execute("create table f(doc_id bigint, fp ubigint)")
    con.executemany("insert into f values (?, ?)", [(r.doc_id, int(r.fingerprint, 16)) for r in found])
    sql = """with recursive e as materialized (select a.doc_id as u, b.doc_id as v from f a join f b on bit_count(xor(a.fp, b.fp)) <= 3 and a.doc_id <> b.doc_id),
     r(u, v) as (select doc_id, doc_id from f union select r.u, e.v from r join e on e.u = r.v) select u, min(v) from r group by 1"""
    assert sorted(con.execute(sql).fetchall()) == sorted((r.doc_id, r.component_id) for r in found)
