"""Queries of text primitives, parsing and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, text as T
from ..sources import adapters
from .registry import ART, RE2_SPACES, VOTE, articles, docs, query, table, voted


@query(f"with {ART} select doc_id, n_words, n_bytes, length(regexp_replace(regexp_replace(text, '^[{RE2_SPACES}]+', ''), '[{RE2_SPACES}]+$', ''))::bigint n_stripped from art")
def text_stats(spark, sf):
    return articles(spark, sf, "text").select("doc_id", "n_words", "n_bytes", F.length(T.strip(F.col("text"))).cast("long").alias("n_stripped"))


_TOK = r"list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+'), lambda t: replace(lower(t), 'ſ', 's')), lambda t: length(t) >= 2)"


@query(f"select doc_id, len({_TOK})::bigint n_tokens, md5(array_to_string({_TOK}, ' ')) digest from documents")
def tokenize(spark, sf):
    t = T.tokens(F.col("text"))
    return docs(spark, sf, "doc_id", "text").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"with {ART}, {VOTE} select doc_id, voted, case when isnan(en_share) then null else round(en_share::double, 5) end en_share from vote")
def guess_lang(spark, sf):
    return voted(spark, sf).select("doc_id", "voted", F.when(~F.isnan("en_share"), F.round(F.col("en_share").cast("double"), 5)).alias("en_share"))


@query(f"with {ART}, {VOTE} select doc_id, round(en_share::double, 5) en_share from vote where voted = 'en' and not isnan(en_share) and en_share >= 0.3")
def native_english(spark, sf):
    v = voted(spark, sf)
    return v.where(language.is_native_english(F.col("voted"), F.col("en_share"))).select("doc_id", F.round(F.col("en_share").cast("double"), 5).alias("en_share"))


_TITLES = "titles as (select source lccn, title_year as year, count(*) n, avg((voted = 'en')::int) f from vote group by all having avg((voted = 'en')::int) >= 0.5)"


@query(f"with {ART}, {VOTE}, {_TITLES} select lccn, year, n, round(f, 9) en_fraction from titles")
def english_titles(spark, sf):
    v = voted(spark, sf).select(F.col("source").alias("lccn"), F.col("title_year").alias("year"), "voted")
    return language.english_titles(v, lang="voted").select("lccn", "year", "n", F.round("en_fraction", 9).alias("en_fraction"))


@query(f"with {ART}, {VOTE}, {_TITLES} select doc_id, source lccn, title_year as year from vote v where exists (select 1 from titles t where t.lccn = v.source and t.year = v.title_year)")
def english_title_rows(spark, sf):
    v = voted(spark, sf).select("doc_id", F.col("source").alias("lccn"), F.col("title_year").alias("year"), "voted")
    return language.keep_english_titles(v, lang="voted").select("doc_id", "lccn", "year")


# names and paths are made of doc_id, some of them broken
_NAME = "'faro_1938/' || date || '_p' || (doc_id % 12 + 1) || '_sn' || (83000000 + doc_id) || case when doc_id % 3 = 0 then '_0051415026_19380520' || lpad((doc_id % 4)::varchar, 2, '0') || '_0256' else '_x' end || case when doc_id % 7 = 0 then '.txt' else '.json' end"


@query(f"""with {ART}, n as (select doc_id, {_NAME} as name from art), b as (select doc_id, split_part(name, '/', 2) base from n),
p as (select doc_id, string_split(regexp_replace(base, '\\.json$', ''), '_') parts from b where regexp_matches(base, '^\\d{{4}}-\\d{{2}}-\\d{{2}}_p\\d+_.*\\.json$'))
select doc_id, parts[1] date, parts[2] page, case when len(parts) >= 5 then substr(parts[-2], 9) else '' end edition, case when len(parts) >= 3 then parts[3] else '' end lccn from p""")
def scan_name_parse(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_0051415026_19380520"), F.lpad((F.col("doc_id") % 4).cast("string"), 2, "0"), F.lit("_0256"))).otherwise("_x")
    end = F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".json")
    name = F.concat(F.lit("faro_1938/"), "date", F.lit("_p"), (F.col("doc_id") % 12 + 1).cast("string"), F.lit("_sn"), (83000000 + F.col("doc_id")).cast("string"), tail, end)
    return articles(spark, sf).select("doc_id", T.scan_name(name).alias("s")).where("s is not null").select("doc_id", "s.*")


_PATH = "'b_ver01/data/sn' || (86000000 + doc_id) || '/' || replace(date, '-', '/') || '/ed-' || (doc_id % 3 + 1) || '/seq-' || (doc_id % 20 + 1) || case when doc_id % 5 = 0 then '/ocr.xml' else '/ocr.txt' end"
_PAT = T.PAGE_PATH.replace("\\", "\\")


@query(f"with {ART}, p as (select doc_id, {_PATH} path from art) select doc_id, " + ", ".join(f"regexp_extract(path, '{_PAT}', {i}) {n}" for i, n in enumerate(("lccn", "\"year\"", "\"month\"", "\"day\"", "edition", "seq"), 1)) + f" from p where regexp_matches(path, '{_PAT}')")
def page_path_parse(spark, sf):
    d = F.col("doc_id")
    path = F.concat(F.lit("b_ver01/data/sn"), (86000000 + d).cast("string"), F.lit("/"), F.replace(F.col("date"), F.lit("-"), F.lit("/")), F.lit("/ed-"), (d % 3 + 1).cast("string"), F.lit("/seq-"), (d % 20 + 1).cast("string"), F.when(d % 5 == 0, "/ocr.xml").otherwise("/ocr.txt"))
    return articles(spark, sf).select("doc_id", T.page_path(path).alias("p")).where("p is not null").select("doc_id", "p.*")


@query("select page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g'))::bigint n_chars, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) digest from pages")
def html_strip(spark, sf):
    t = T.strip_tags(F.col("html"))
    return table(spark, sf, "pages", "page_id", "html").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


_TEI = "'<date type=\"publication\"> ' || (1800 + doc_id % 150) || '</date><text><fw>head ' || doc_id || '</fw><p>' || text || 'Ver-<lb/>fassung</p></text>'"


@query(f"""with x as (select doc_id, {_TEI} as xml from documents)
select doc_id, regexp_extract(xml, '<date type="publication">\\s*(\\d{{4}})', 1)::int as year,
  md5(regexp_replace(regexp_replace(regexp_replace(substr(xml, strpos(xml, '<text') + 5), '(?s)<fw\\b[^>]*>.*?</fw>', ' ', 'g'), '[-¬]\\s*<lb\\s*/>\\s*', '', 'g'), '<[^>]+>', ' ', 'g')) digest from x""")
def tei_text(spark, sf):
    d = F.col("doc_id")
    xml = F.concat(F.lit('<date type="publication"> '), (1800 + d % 150).cast("string"), F.lit("</date><text><fw>head "), d.cast("string"), F.lit("</fw><p>"), F.col("text"), F.lit("Ver-<lb/>fassung</p></text>"))
    return docs(spark, sf, "doc_id", "text").select("doc_id", T.tei_year(xml).alias("year"), F.md5(T.tei_body(xml)).alias("digest"))


@query("""select doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || ',"none":null,"source":"' || source || '"}' meta from documents""")
def meta_json(spark, sf):
    return docs(spark, sf, "doc_id", "lang", "n_chars", "source").select("doc_id", T.meta_json(F.col("lang"), F.col("n_chars"), F.lit(None).cast("string").alias("none"), F.col("source")).alias("meta"))


@query("select * from (select event_id, json_extract_string(props, '$.\"' || k || '\"') as v, k from (select event_id, props, unnest(json_keys(props)) k from events)) where v is not null")
def json_extract(spark, sf):
    own = table(spark, sf, "events", "event_id", "props").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return own.where("v is not null")


@query("select doc_id, case when doc_id % 4 = 0 then 9999 else 1600 + doc_id % 300 end as year from documents")
def tei_file_year(spark, sf):
    d = F.col("doc_id")
    year = F.when(d % 4 == 0, "x").otherwise((1600 + d % 300).cast("string"))
    return docs(spark, sf, "doc_id").select("doc_id", T.tei_file_year(F.concat(F.lit("a/name_"), year, F.lit("1.TEI-P5.xml"))).alias("year"))


@query("select conv_id, string_agg(role, ';' order by turn, role) roles from conversations group by 1")
def array_join(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ";").alias("roles"))


_YEAR = "case doc_id % 6 when 0 then (1900 + doc_id % 50)::varchar when 1 then (1900 + doc_id % 50) || '.0' when 2 then '' when 3 then 'nan' when 4 then 'c. 1920' else ' ' || (1850 + doc_id % 90) || '.7 ' end"


@query(f"select doc_id, case when isnan(try_cast(trim({_YEAR}) as double)) then null else trunc(try_cast(trim({_YEAR}) as double))::int end as year from documents")
def safe_year(spark, sf):
    d = F.col("doc_id")
    y = lambda a, m: (a + d % m).cast("string")
    raw = F.when(d % 6 == 0, y(1900, 50)).when(d % 6 == 1, F.concat(y(1900, 50), F.lit(".0"))).when(d % 6 == 2, "").when(d % 6 == 3, "nan").when(d % 6 == 4, "c. 1920").otherwise(F.concat(F.lit(" "), y(1850, 90), F.lit(".7 ")))
    return docs(spark, sf, "doc_id").select("doc_id", T.safe_year(raw).alias("year"))


_TEXTDATE = "case when doc_id % 11 = 0 then '1939-02-30' when doc_id % 13 = 0 then 'x' else date end"


@query(f"with {ART} select doc_id, coalesce(year(try_cast({_TEXTDATE} as date)) = title_year, false) ok from art")
def valid_date(spark, sf):
    raw = F.when(F.col("doc_id") % 11 == 0, "1939-02-30").when(F.col("doc_id") % 13 == 0, "x").otherwise(F.col("date"))
    return articles(spark, sf).select("doc_id", T.valid_date(raw, F.col("title_year")).alias("ok"))


# congressional rows of documents: some dates broken, some texts blank
_RAW = "case when doc_id % 17 = 0 then '1939xx01' else replace(date, '-', '') end"
_TXT = "case when doc_id % 19 = 0 then ' ' || chr(160) else text end"
_CR = f"""{ART}, cr as (select *, case when doc_id % 17 = 0 then null else day end d, {_TXT} t from art),
crd as (select *, case when d is null then 'dropped_bad_date' when d > date '1939-06-30' then 'dropped_after_cutoff' when regexp_replace(t, '[{RE2_SPACES}]+', '', 'g') = '' then 'dropped_empty' end drop_reason from cr)"""


def _cr(spark, sf):
    d = F.col("doc_id")
    raw = articles(spark, sf, "text", "lang").select(
        d.alias("speech_id"), F.when(d % 17 == 0, "1939xx01").otherwise(F.replace(F.col("date"), F.lit("-"), F.lit(""))).alias("date"), F.when(d % 3 == 0, "S").when(d % 3 == 1, "H").otherwise("J").alias("chamber"),
        F.lit("").alias("speaker"), F.lit("NY").alias("state"), F.lit(76).alias("congress"), F.lit("").alias("party"), "source", F.when(d % 19 == 0, F.lit("  ")).otherwise(F.col("text")).alias("speech_text"),
    )
    return adapters.congressional_record(raw)


@query(f"with {_CR} select 'cr_' || doc_id article_id, drop_reason from crd")
def cutoff_drop_reasons(spark, sf):
    return _cr(spark, sf).select("article_id", "drop_reason")


@query(f"with {_CR} select case when grouping(s) = 0 then s end source, case when grouping(r) = 0 then r end reason, count(*) n from (select 'congressional_record' s, coalesce(drop_reason, '') r from crd) group by rollup (s, r)")
def drop_counts(spark, sf):
    return adapters.drop_counts(_cr(spark, sf))


@query(f"""with {_CR} select 'cr_' || doc_id article_id, year(d)::int as year, date, 'Congressional Record (' || case doc_id % 3 when 0 then 'Senate' when 1 then 'House' else 'J' end || ')' newspaper, n_words, strlen(regexp_replace(regexp_replace(t, '^[{RE2_SPACES}]+', ''), '[{RE2_SPACES}]+$', ''))::bigint n_bytes, '' lccn, 'NY' state
from crd where drop_reason is null""")
def article_projection(spark, sf):
    kept = adapters.keep(_cr(spark, sf), with_language=False)
    return kept.select("article_id", F.col("year").cast("int").alias("year"), "date", "newspaper", F.col("n_words").cast("long").alias("n_words"), F.col("n_bytes").cast("long").alias("n_bytes"), "lccn", "state")


@query("select doc_id, case doc_id % 3 when 0 then 'Senate' when 1 then 'House' else 'J' end chamber from documents")
def code_map(spark, sf):
    code = F.when(F.col("doc_id") % 3 == 0, "S").when(F.col("doc_id") % 3 == 1, "H").otherwise("J")
    names = F.create_map(F.lit("S"), F.lit("Senate"), F.lit("H"), F.lit("House"))
    return docs(spark, sf, "doc_id").select("doc_id", F.coalesce(F.try_element_at(names, code), code).alias("chamber"))


@query(f"with {ART} select doc_id, date from art where day between date '1930-01-01' and date '1939-06-30'")
def period_filter(spark, sf):
    return articles(spark, sf).where(F.col("day").between("1930-01-01", "1939-06-30")).select("doc_id", "date")


@query("select doc_id, case when lang = 'en' then 'ingested' else 'ingested_foreign/' || lang end root from documents")
def language_root(spark, sf):
    return docs(spark, sf, "doc_id", "lang").select("doc_id", adapters.language_root(F.col("lang")).alias("root"))
