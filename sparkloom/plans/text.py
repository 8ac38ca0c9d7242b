"""Text functions and chunking on rows made from `part` and `documents`."""

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import chunking as C
from sparkloom.operators import memory as M
from sparkloom.plans.views import ctes, view
from sparkloom.streaming.rollups import joined_deltas
from sparkloom.tables import table

def key():
    return F.col("p_partkey")


def part(s, d):
    return table(s, d, "part")


def pick(*values):
    """One of the values by the row's key."""
    return F.element_at(F.array(*map(F.lit, values)), (key() % len(values) + 1).cast("int"))


def sql_pick(*values):
    return "CASE p_partkey % " + str(len(values)) + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


NUMBERS = ("二十七", "十", "一百零三", "两千零五", "一万二千", "27", "", "百", "x三", "三十", "万", " 三 百 ", "十万零八十", "〇")
NAMES = ("001_中华人民共和国增值税法.docx", "12-企业所得税法__实施条例.pdf", "税收征管办法.docx", "1000 关于发票的通知.docx", "批复意见.xlsx", "说明.pdf", "2024.v1.docx", "77", "_a__b_.x")
TITLES = ("中华人民共和国增值税法", "企业所得税法 实施条例", "税收征管办法", "关于发票的通知", "批复意见", "说明", "实施细则", "公告答复", "办法的法规定")
URLS = ("redis://user:secret@host/0", "redis://token@host/0", "http://host/a@b", "amqp://u:p:q@h", "", "http://:p@h", "nothing")
ERRORS = ("Quota exceeded", "HTTP 429 Too Many Requests", "账户余额不足", "boom", "并发限制", "Rate Limit and billing", "限流", "")
ENTITIES = ("《增值税》", " 小规模纳税人等 ", "“出口退税”的", "（研发费用）有关规定", "税", "的", "一二的", "（一二三等）相关", "")
TYPES = ("tax_type", "税种", " Taxpayer ", "other", "`procedure`", "征管事项。", "")
ANSWERS = ('{"a":1}', 'text ```json\n{"a":2}\n``` end', 'so {"a":[1,2,],} ok', "none", "[1]", '```\n{"b":{}}\n```', "{", 'x {"a":1} y {"b":2}')
CONTENTS = ('{"a":{', "{}", "}{{", "", "no braces")
SENTENCES = ("自2020年起施行", "特此公告", "纳税人应当", "同时废止", "废止的", "自公布之日，起施行", "特此说明。")


def _lines(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("corpus\\d"), F.col("doc_id").cast("string")).alias("source_path"), C.paragraphs(F.col("text")).alias("paragraphs"))


def _deltas(s, d):
    k = F.col("turn")
    return table(s, d, "conversations").select(F.col("conv_id").alias("request_id"), k.alias("seq"), F.col("role").alias("delta"), F.when(k % 2 == 0, k).alias("usage"), F.when(k == 1, "stop").alias("finish_reason"))


def _memories(s, d):
    rows = table(s, d, "customer")
    return rows.select(
        F.col("c_custkey").alias("id"), F.lit("fact").alias("memory_type"), F.lit("user").alias("scope"), F.floor(F.col("c_custkey") / 12).cast("string").alias("scope_key"),
        F.concat(F.lit("Likes "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "!").otherwise("")).alias("content"), (F.col("c_custkey") % 5 + 1).cast("int").alias("importance"),
        F.array(F.col("c_mktsegment")).alias("tags"), F.col("c_custkey").cast("string").alias("request_id"), F.col("c_custkey").alias("ord"),
    )


QUERIES = {
    "b01_file_metadata": lambda s, d: part(s, d).select("p_partkey", pick(*NAMES).alias("name")).select("p_partkey", *(c.alias(n) for c, n in zip(C.file_metadata(F.col("name")), ("title", "file_no")))),
    "b02_document_type": lambda s, d: part(s, d).select("p_partkey", C.document_type(pick(*TITLES)).alias("doc_type")),
    "b03_paragraphs": lambda s, d: table(s, d, "documents").select("doc_id", F.size(C.paragraphs(F.col("text"))).cast("bigint").alias("n")),
    "b04_clauses": lambda s, d: C.clauses(part(s, d).select(F.col("p_size").alias("doc_id"), "p_partkey", F.when(key() % 4 == 0, F.concat(F.lit("第"), key().cast("string"), F.lit("条 开始。"))).when(key() % 9 == 1, F.lit("第一章 总则")).otherwise(F.col("p_name")).alias("line")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]).alias("paragraphs"))).select("doc_id", "section", "text"),
    "b05_sentences": lambda s, d: part(s, d).select("p_partkey", F.array_join(C.sentences(F.concat(F.col("p_name"), F.lit("。 。？"), F.col("p_type"), F.lit("；尾"))), "|").alias("sentences")),
    "b07_chunks": lambda s, d: C.chunks(_lines(s, d), 800, 40, 300).select("doc_id", "id", "chunk_index", "parent_id", F.length("text").alias("n")),
    "b08_chunk_ids": lambda s, d: part(s, d).select("p_partkey", C.chunk_id(F.col("p_name"), key(), F.col("p_type")).alias("id"), C.stable_key(C.chunk_id(F.col("p_name"), key(), F.col("p_type"))).alias("pk")),
    "b10_document_keys": lambda s, d: part(s, d).select("p_partkey", C.document_key(F.concat(F.lit("a\\"), F.col("p_name"))).alias("doc_id")),
    "b11_batches": lambda s, d: C.batches(part(s, d).select("p_size", "p_partkey", F.col("p_name").alias("t"), F.col("p_type").alias("x")), "p_size", "p_partkey", "t", "x", most=7, most_chars=300),
    "b14_successors": lambda s, d: C.successors(table(s, d, "documents").select("doc_id", F.col("doc_id").alias("ord")), "ord", "doc_id"),
    "b16_clipped": lambda s, d: table(s, d, "documents").select("doc_id", X.clipped(F.col("text"), 512).alias("t"), X.clipped(F.col("source"), 3).alias("x")),
    "x01_numerals": lambda s, d: part(s, d).select("p_partkey", X.numeral(pick(*NUMBERS)).alias("n")),
    "x02_titles": lambda s, d: part(s, d).select("p_partkey", X.normal_title(F.concat(F.lit("《 中华人民共和国"), F.col("p_name"), F.lit(" 》"))).alias("title"), X.short_title(F.concat(F.lit("《中华人民共和国 "), F.col("p_brand"), F.lit("》"))).alias("short")),
    "x04_implemented": lambda s, d: part(s, d).select("p_partkey", X.implemented_title(F.concat(F.lit("《 所得税法"), pick("实施条例", "实施细则", "暂行条例", ""), F.lit("》"))).alias("law")),
    "x05_citations": lambda s, d: part(s, d).select("p_partkey", F.explode(X.citations(F.concat(F.lit("依照《甲法》第"), key().cast("string"), F.lit("条第二款第（三）项；本条例第"), pick(*NUMBERS[:5]), F.lit("条规定")))).alias("c")).select("p_partkey", "c.*"),
    "x06_title_references": lambda s, d: part(s, d).select("p_partkey", F.array_join(X.title_references(F.concat(F.lit("《甲法》与《乙 "), F.col("p_brand"), F.lit("》及《甲法》"))), ",").alias("names")),
    "x07_section_article": lambda s, d: part(s, d).select("p_partkey", X.section_article(F.concat(F.lit(" 第 "), pick(*NUMBERS[:5]), F.lit(" 条"))).alias("article")),
    "x08_entity_names": lambda s, d: part(s, d).select("p_partkey", X.entity_name(pick(*ENTITIES)).alias("name"), X.entity_type(pick(*TYPES)).alias("type")),
    "x10_squeezed": lambda s, d: table(s, d, "documents").select("doc_id", F.length(X.squeezed(F.col("text"))).alias("n")),
    "x11_mention_kinds": lambda s, d: part(s, d).select("p_partkey", X.mention_kind(F.when(key() % 4 == 0, F.substring("p_name", 1, 8)).when(key() % 4 == 1, F.concat(F.substring("p_type", 1, 5), F.lit("zq"))).otherwise(pick("zqj9", "", "ab")), X.squeezed(F.concat("p_name", F.col("p_type")))).alias("kind")),
    "x15_message_titles": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", X.message_title(F.concat(F.lit("  "), F.col("role"), F.lit(" \t"), F.lit("m" * 60))).alias("title")),
    "x19_truncated": lambda s, d: part(s, d).select("p_partkey", X.is_truncated(F.when(key() % 3 == 0, "length").when(key() % 3 == 1, "stop"), pick(*CONTENTS)).alias("truncated")),
    "x20_failures": lambda s, d: part(s, d).select("p_partkey", X.failure_kind(pick(*ERRORS)).alias("kind")),
    "x21_salvaged": lambda s, d: part(s, d).select("p_partkey", X.salvaged_json(pick(*ANSWERS)).alias("json")),
    "x23_masked_urls": lambda s, d: part(s, d).select("p_partkey", X.masked_url(pick(*URLS)).alias("url")),
    "x24_procedural": lambda s, d: part(s, d).select("p_partkey", X.is_procedural(pick(*SENTENCES)).alias("procedural")),
    "x13_statement_keys": lambda s, d: part(s, d).select("p_partkey", X.statement_key(F.concat("p_name", F.lit(" Ａ-"), "p_brand")).alias("key")),
    "x14_sequence_ratio": lambda s, d: part(s, d).select("p_partkey", F.round(X.sequence_ratio("p_name", "p_type"), 6).alias("ratio")),
    "x27_payload_rows": lambda s, d: M.from_payload(part(s, d).select(F.when(key() % 2 == 0, key().cast("string")).alias("user_id"), F.col("p_brand").alias("project"), F.concat(F.lit('{"preferences":[{"content":"'), F.col("p_name"), F.lit('","importance":5},{"content":" "}],"facts":[{"content":"f"}]}')).alias("payload"))),
    "k01_memory_merge": lambda s, d: M.merged(_memories(s, d)).select("id", "scope_key", "content", "importance", "merge_count"),
    "k01_memory_merge_exact": lambda s, d: M.merged_exact(_memories(s, d)),
    "l01_joined_deltas": lambda s, d: joined_deltas(_deltas(s, d)),
}
TITLE_SQL = r"regexp_replace(regexp_replace({}, '\s+', '', 'g'), '^[《》]+|[《》]+$', '', 'g')"
SHORT_SQL = " ".join(f"WHEN starts_with(u, '{p}') AND length(u) > {len(p) + 1} THEN substring(u, {len(p) + 1})" for p in X.TITLE_PREFIXES)
LETTERS = "[零〇一二两三四五六七八九十百千万]"
MANY = f"[{X.NUMERAL}]+"


def sql_squeezed(e):
    return rf"regexp_replace(coalesce({e}, ''), '\s+', '', 'g')"


def sql_numeral(e):
    """Digits as they are; else letter by letter: a digit waits, a unit multiplies it (1 without one), ten thousand multiplies what came before."""
    s, row = sql_squeezed(e), "{{'t': CAST({} AS BIGINT), 'g': CAST({} AS BIGINT), 'd': CAST({} AS BIGINT), 'c': b.c}}".format
    zero = "{'t': CAST(0 AS BIGINT), 'g': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT), 'c': ''}"
    step = f"""CASE WHEN strpos('零一二三四五六七八九', b.c) > 0 THEN {row('a.t', 'a.g', "strpos('零一二三四五六七八九', b.c) - 1")} WHEN b.c = '〇' THEN {row('a.t', 'a.g', '0')} WHEN b.c = '两' THEN {row('a.t', 'a.g', '2')}
      WHEN b.c = '万' THEN {row('a.t + (a.g + a.d) * 10000', '0', '0')} ELSE {row('a.t', "a.g + greatest(a.d, 1) * CASE b.c WHEN '十' THEN 10 WHEN '百' THEN 100 ELSE 1000 END", '0')} END"""
    letters = f"list_prepend({zero}, list_transform(string_split({s}, ''), lambda x: {{'t': CAST(0 AS BIGINT), 'g': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT), 'c': x}}))"
    state = f"list_reduce({letters}, lambda a, b: {step})"
    return f"CASE WHEN regexp_full_match({s}, '[0-9]+') THEN CAST({s} AS BIGINT) WHEN regexp_full_match({s}, '{LETTERS}+') THEN ({state}).t + ({state}).g + ({state}).d END"


def sql_title(e):
    return f"regexp_replace({sql_squeezed(e)}, '^[《》]+|[《》]+$', '', 'g')"


def sql_entity(e):
    marks = X.OUTER_MARKS.replace("'", "''")
    name = f"trim({sql_squeezed(e)}, '{marks}')"
    for noise in X.TRAILING_NOISE:
        name = rf"regexp_replace({name}, '^(.{{3,}}){noise}$', '\1')"
    return f"trim({name}, '{marks}')"


def sql_any(words, text):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def rule(values, select):
    """SQL over part with v: the row's value of these."""
    quoted = [v.replace("'", "''") for v in values]
    return f"WITH v AS (SELECT *, {sql_pick(*quoted)} AS v FROM part) SELECT p_partkey, {select} FROM v"


FILE_NO = r"'^\s*([0-9]{1,4})\s*[_\-．.、]?\s*(.*)$'"
BASE = r"regexp_replace(v, '(.)\.[^.]*$', '\1')"
TYPE = f"trim({sql_squeezed('v')}, '`\"''。.：:')"
CASES = " ".join(f"WHEN {t} IN ('{k}', '{v}') THEN '{k}'" for t in (TYPE, f"lower({TYPE})") for k, v in X.ENTITY_TYPES.items())
T = r"trim(v, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
FENCED, BRACES = rf"trim(regexp_extract({T}, '(?s)```(?:json)?\s*(.*?)```', 1), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))", rf"regexp_extract({T}, '(?s)(\{{.*\}})', 1)"
TIDY = rf"regexp_replace({BRACES}, ',\s*([}}\]])', '\1', 'g')"
CITED = rf"(本(?:法|条例|办法|细则|规定|规则)|《[^》]{{2,60}}》)\s*第\s*({MANY})\s*条(?:\s*第\s*({MANY})\s*款)?(?:\s*第?\s*[（(]\s*({MANY})\s*[)）]\s*项)?"
ORACLES = {
    "b01_file_metadata": rule(NAMES, rf"trim(regexp_replace(trim(CASE WHEN regexp_extract({BASE}, {FILE_NO}, 1) <> '' AND regexp_extract({BASE}, {FILE_NO}, 2) <> '' THEN regexp_extract({BASE}, {FILE_NO}, 2) ELSE {BASE} END), '_+', ' ', 'g')) AS title, regexp_extract({BASE}, {FILE_NO}, 1) AS file_no"),
    "b02_document_type": rule(TITLES, "CASE WHEN contains(v, '条例') THEN '条例' WHEN contains(v, '法') AND NOT contains(v, '办法') THEN '法律' WHEN contains(v, '办法') OR contains(v, '规定') OR contains(v, '细则') THEN '规章/办法' WHEN contains(v, '通知') OR contains(v, '公告') THEN '通知/公告' WHEN contains(v, '批复') OR contains(v, '答复') OR contains(v, '意见') THEN '批复/答复' ELSE '其他' END AS doc_type"),
    "b03_paragraphs": r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s]'))) AS BIGINT) AS n FROM documents",
    "b04_clauses": """WITH l AS (SELECT p_size AS doc_id, p_partkey, p_partkey % 4 = 0 AS opens, CASE WHEN p_partkey % 4 = 0 THEN '第' || CAST(p_partkey AS VARCHAR) || '条 开始。' WHEN p_partkey % 9 = 1 THEN '第一章 总则' ELSE p_name END AS line FROM part),
      g AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p_partkey) AS c FROM l WHERE line <> '第一章 总则')
      SELECT doc_id, coalesce(max(CASE WHEN opens THEN '第' || CAST(p_partkey AS VARCHAR) || '条' END), '全文') AS section, string_agg(line, ' ' ORDER BY p_partkey) AS text FROM g GROUP BY doc_id, c""",
    "b05_sentences": rf"""WITH x AS (SELECT p_partkey, p_name || '。 。？' || p_type || '；尾' AS t FROM part),
      s AS (SELECT p_partkey, trim(unnest(regexp_extract_all(t, '[^{C.ENDERS}]*[{C.ENDERS}](?:\s*[{C.ENDERS}])*|[^{C.ENDERS}]+$'))) AS s, generate_subscripts(regexp_extract_all(t, '[^{C.ENDERS}]*[{C.ENDERS}](?:\s*[{C.ENDERS}])*|[^{C.ENDERS}]+$'), 1) AS i FROM x),
      k AS (SELECT p_partkey, i, regexp_extract(s, '^[^{C.ENDERS}]*') AS body, regexp_replace(regexp_replace(s, '^[^{C.ENDERS}]*', ''), '\s+', '', 'g') AS tail FROM s)
      SELECT p_partkey, string_agg(body || tail, '|' ORDER BY i) AS sentences FROM k WHERE body <> '' GROUP BY 1""",
    "b08_chunk_ids": "SELECT p_partkey, id, CAST('0x' || substring(sha1(id), 1, 15) AS BIGINT) AS pk FROM (SELECT p_partkey, substring(sha1(p_name || '#' || CAST(p_partkey AS VARCHAR) || '#' || p_type), 1, 20) AS id FROM part)",
    "b10_document_keys": r"SELECT p_partkey, 'doc:' || replace(path, '\', '/') AS doc_id FROM (SELECT p_partkey, 'a\' || p_name AS path FROM part)",
    "b14_successors": "SELECT doc_id, next FROM (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS next FROM documents) WHERE next IS NOT NULL",
    "b16_clipped": "SELECT doc_id, substring(text, 1, 512) AS t, substring(source, 1, 3) AS x FROM documents",
    "x01_numerals": rule(NUMBERS, f"{sql_numeral('v')} AS n"),
    "x02_titles": rf"""WITH x AS (SELECT p_partkey, '《 中华人民共和国' || p_name || ' 》' AS t, '《中华人民共和国 ' || p_brand || '》' AS u FROM part),
      n AS (SELECT p_partkey, {TITLE_SQL.format('t')} AS title, {TITLE_SQL.format('u')} AS u FROM x) SELECT p_partkey, title, CASE {SHORT_SQL} ELSE u END AS short FROM n""",
    "x04_implemented": rule(("实施条例", "实施细则", "暂行条例", ""), "CASE WHEN ends_with(t, '实施条例') OR ends_with(t, '实施细则') THEN left(t, -4) END AS law").replace("FROM v", f"FROM (SELECT *, {sql_title("'《 所得税法' || v || '》'")} AS t FROM v)"),
    "x05_citations": rule(NUMBERS[:5], "unnest(regexp_extract_all(t, '{0}', 1)) AS law, unnest(regexp_extract_all(t, '{0}', 2)) AS c1, unnest(regexp_extract_all(t, '{0}', 3)) AS c2, unnest(regexp_extract_all(t, '{0}', 4)) AS c3".format(CITED)).replace("FROM v", "FROM (SELECT p_partkey, '依照《甲法》第' || CAST(p_partkey AS VARCHAR) || '条第二款第（三）项；本条例第' || v || '条规定' AS t FROM v)")
      .replace("SELECT p_partkey, unnest", f"SELECT p_partkey, law, {sql_numeral('c1')} AS article, {sql_numeral('c2')} AS paragraph, {sql_numeral('c3')} AS item FROM (SELECT p_partkey, unnest") + ")",
    "x06_title_references": f"""SELECT p_partkey, string_agg(n, ',' ORDER BY i) AS names FROM (SELECT p_partkey, n, min(i) AS i FROM (SELECT p_partkey, {sql_title('x')} AS n, i FROM (SELECT p_partkey, unnest(names) AS x, generate_subscripts(names, 1) AS i
      FROM (SELECT p_partkey, regexp_extract_all('《甲法》与《乙 ' || p_brand || '》及《甲法》', '《([^》]{{2,60}})》', 1) AS names FROM part))) WHERE n <> '' GROUP BY 1, 2) GROUP BY 1""",
    "x07_section_article": rule(NUMBERS[:5], rf"""{sql_numeral(rf"regexp_extract(' 第 ' || v || ' 条', '^\s*第\s*({MANY})\s*条', 1)")} AS article"""),
    "x08_entity_names": "WITH v AS (SELECT p_partkey, {} AS v, {} AS w FROM part) SELECT p_partkey, {} AS name, CASE {} END AS type FROM v".format(sql_pick(*ENTITIES), sql_pick(*TYPES), sql_entity("v"), CASES.replace("(v,", "(w,")),
    "x10_squeezed": r"SELECT doc_id, CAST(length(regexp_replace(text, '\s+', '', 'g')) AS INTEGER) AS n FROM documents",
    "x11_mention_kinds": f"""WITH v AS (SELECT p_partkey, {sql_entity("CASE p_partkey % 4 WHEN 0 THEN substring(p_name, 1, 8) WHEN 1 THEN substring(p_type, 1, 5) || 'zq' ELSE CASE p_partkey % 3 WHEN 0 THEN 'zqj9' WHEN 1 THEN '' ELSE 'ab' END END")} AS n, {sql_squeezed('p_name || p_type')} AS t FROM part)
      SELECT p_partkey, CASE WHEN n = '' THEN 'absent' WHEN contains(t, n) THEN 'exact' WHEN length(n) >= 3 AND len(list_filter(range(1, length(n) - 1), lambda i: contains(t, substring(n, i, 3)))) > 0 THEN 'partial' ELSE 'absent' END AS kind FROM v""",
    "x15_message_titles": r"SELECT conv_id, turn, substring(trim(regexp_replace(m, '\s+', ' ', 'g')), 1, 40) AS title FROM (SELECT conv_id, turn, '  ' || role || ' ' || chr(9) || repeat('m', 60) AS m FROM conversations)",
    "x19_truncated": rule(CONTENTS, "p_partkey % 3 = 0 OR length(replace(v, '}', '')) - length(replace(v, '{', '')) > 0 AS truncated"),
    "x20_failures": rule(ERRORS, f"CASE WHEN {sql_any(X.QUOTA_HINTS, 'lower(v)')} THEN 'quota' WHEN {sql_any(X.RATE_HINTS, 'lower(v)')} THEN 'rate_limit' ELSE 'other' END AS kind"),
    "x21_salvaged": rule(ANSWERS, "CASE " + " ".join(f"WHEN starts_with({c}, '{{') AND json_valid({c}) AND NOT regexp_matches({c}, ',[ ]*[}}\\]]') THEN {c}" for c in (T, FENCED, BRACES, TIDY)) + " END AS json"),
    "x23_masked_urls": rule(URLS, r"CASE WHEN regexp_matches(v, '^[a-z0-9+.-]+://[^@/:]*:[^@/]*@') THEN regexp_replace(v, '^([a-z0-9+.-]+://)([^@/:]*):[^@/]*@', '\1\2:***@') ELSE regexp_replace(v, '^([a-z0-9+.-]+://)[^@/]+@', '\1***@') END AS url"),
    "x24_procedural": rule(SENTENCES, f"regexp_matches(v, '{X.PROCEDURAL}') AS procedural"),
    "x13_statement_keys": "SELECT p_partkey, regexp_replace(lower(p_name || 'a' || p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part",
    "x27_payload_rows": """WITH b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'user' ELSE 'project' END AS scope, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS scope_key, p_name FROM part)
      SELECT 'preference' AS memory_type, scope, scope_key, p_name AS content, 5 AS importance FROM b UNION ALL SELECT 'fact', scope, scope_key, 'f', 3 FROM b""",
    "b11_batches": """WITH RECURSIVE r AS (SELECT p_size, p_partkey, length(p_name) + length(p_type) + 8 AS cost, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i FROM part),
      g AS (SELECT p_size, p_partkey, i, 0 AS batch, 1 AS n, cost AS used FROM r WHERE i = 1
        UNION ALL SELECT r.p_size, r.p_partkey, r.i, g.batch + CASE WHEN full_ THEN 1 ELSE 0 END, CASE WHEN full_ THEN 1 ELSE g.n + 1 END, CASE WHEN full_ THEN r.cost ELSE g.used + r.cost END
        FROM (SELECT g.*, r.cost AS next_cost, g.n >= 7 OR g.used + r.cost > 300 AS full_ FROM g JOIN r ON r.p_size = g.p_size AND r.i = g.i + 1) g JOIN r ON r.p_size = g.p_size AND r.i = g.i + 1)
      SELECT p_size, p_partkey, CAST(batch AS INTEGER) AS batch, 'c' || CAST(n AS VARCHAR) AS ref FROM g""",
    # the contents differ by a mark at most, or by far more than the ratio allows
    "k01_memory_merge": """WITH m AS (SELECT c_custkey AS o, CAST(c_custkey // 12 AS VARCHAR) AS scope_key, c_mktsegment AS s, 'Likes ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END AS content, CAST(c_custkey % 5 + 1 AS INTEGER) AS importance FROM customer)
      SELECT min(o) AS id, scope_key, arg_max(content, (length(content), -o)) AS content, max(importance) AS importance, CAST(count(*) - 1 AS INTEGER) AS merge_count FROM m GROUP BY scope_key, s""",
    "k01_memory_merge_exact": """WITH m AS (SELECT c_custkey AS o, CAST(c_custkey // 12 AS VARCHAR) AS scope_key, c_mktsegment AS s, 'Likes ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END AS content, CAST(c_custkey % 5 + 1 AS INTEGER) AS importance FROM customer)
      SELECT 'fact' AS memory_type, 'user' AS scope, scope_key, arg_max(content, (length(content), -o)) AS content, max(importance) AS importance, count(*) - 1 AS merge_count FROM m GROUP BY scope_key, s""",
    "l01_joined_deltas": """SELECT conv_id AS request_id, string_agg(role, '' ORDER BY turn) AS text, max(CASE WHEN turn % 2 = 0 THEN turn END) AS tokens, max(CASE WHEN turn = 1 THEN 'stop' END) AS finish_reason FROM conversations GROUP BY 1""",
}
