"""The queries as DuckDB SQL, written against the raw tables and the views' definitions."""

from __future__ import annotations

from quire.functions.numerals import NUMERAL, TITLE_NUMERAL
from quire.functions.text import MEDIA_TYPES, RESERVED, SPACE
from quire.plans.views import CHAPTERS, LAYERS, LF, MARKED_LINES, MARKERS, NUMBERED, PAD, QUOTED, QUOTED_LINES, SPACED, VOLUMES, WORK, conflicting_sql, paragraphs_sql, q, strip_sql

PARAS = f"SELECT doc_id, lang, {paragraphs_sql('text')} AS p FROM ({SPACED})"
COUNTED = f"SELECT doc_id, lang, len(p) AS n_paras, list_sum(list_transform(p, lambda x: length(x))) AS n_chars FROM ({PARAS})"
WAN = "printf('%.1f', {} / 10000.0) || '万字'"
PAIRED = "list_aggregate(list_transform(string_split({x}, '\"'), lambda x, i: CASE WHEN i = 1 THEN '' WHEN i % 2 = 0 THEN '“' ELSE '”' END || x), 'string_agg', '')"
WIDE = "replace(replace({}, '!', '！'), '?', '？')"
ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
BASE, COR, EXTRA = (LAYERS[n] for n in ("base", "corrected", "extra"))


def _lines(name: str, sql: str) -> str:
    p = paragraphs_sql("text")
    return f"{name} AS (SELECT chapter_key, unnest({p}) AS t, unnest(range(len({p}))) + 1 AS line_no FROM ({sql}))"


def _last(sql: str) -> str:
    """Of several files with one key the greatest name."""
    return f"SELECT work_id, chapter_key, max(file_name) AS file_name, max_by(text, file_name) AS text FROM ({sql}) GROUP BY work_id, chapter_key"


MERGE_BASE = f"SELECT {WORK} AS work_id, {PAD} AS chapter_key, {PAD} || CASE WHEN doc_id % 20 = 0 THEN ' 书籍信息.txt' ELSE ' a.txt' END AS file_name, text FROM documents"
MERGE_FIX = f"SELECT {WORK} AS work_id, {PAD} AS chapter_key, {PAD} || ' b.txt' AS file_name, replace(text, 'en', 'EN') AS text FROM documents WHERE doc_id % 20 <> 0 AND doc_id % 3 <> 1"

DIFFS = f"""WITH {_lines('a', BASE)}, {_lines('b', COR)},
keys AS (SELECT x.chapter_key FROM ({BASE}) x JOIN ({COR}) y ON x.chapter_key = y.chapter_key),
n AS (SELECT k.chapter_key, least((SELECT count(*) FROM a WHERE a.chapter_key = k.chapter_key), (SELECT count(*) FROM b WHERE b.chapter_key = k.chapter_key)) AS shorter FROM keys k),
d AS (SELECT coalesce(a.chapter_key, b.chapter_key) AS chapter_key, CAST(coalesce(a.line_no, b.line_no) AS BIGINT) AS line_no, a.t AS text1, b.t AS text2 FROM a FULL JOIN b ON a.chapter_key = b.chapter_key AND a.line_no = b.line_no WHERE a.t IS DISTINCT FROM b.t),
e AS (SELECT d.*, n.shorter, CASE WHEN text1 IS NULL THEN 'only_in_2' WHEN text2 IS NULL THEN 'only_in_1' ELSE 'changed' END AS kind,
 list_position(list_transform(list_zip(string_split(text1, ''), string_split(text2, '')), lambda c: c[1] IS DISTINCT FROM c[2]), true) AS pos FROM d JOIN n ON d.chapter_key = n.chapter_key)"""
#: All lines that differ, of chapters in either layer.
STATUS = f"""WITH {_lines('a', BASE)}, {_lines('b', COR)},
d AS (SELECT coalesce(a.chapter_key, b.chapter_key) AS chapter_key, count(*) FILTER (a.t IS DISTINCT FROM b.t) AS n_diffs FROM a FULL JOIN b ON a.chapter_key = b.chapter_key AND a.line_no = b.line_no GROUP BY 1),
s AS (SELECT coalesce(x.work_id, y.work_id) AS work_id, coalesce(x.chapter_key, y.chapter_key) AS chapter_key, coalesce(y.file_name, x.file_name) AS file_name, coalesce(n_diffs, 0) AS n_diffs,
 CASE WHEN y.chapter_key IS NULL THEN 'only_baseline' WHEN x.chapter_key IS NULL THEN 'only_corrected' WHEN coalesce(n_diffs, 0) > 0 THEN 'modified' WHEN x.file_name <> y.file_name THEN 'renamed_only' ELSE 'unchanged' END AS status
 FROM ({BASE}) x FULL JOIN ({COR}) y ON x.chapter_key = y.chapter_key LEFT JOIN d ON d.chapter_key = coalesce(x.chapter_key, y.chapter_key))"""
ORD = "CAST(prefix AS BIGINT)"
NUMERAL_SQL = f"""SELECT p_partkey, CASE WHEN n = 0 THEN '零' ELSE regexp_replace(regexp_replace(regexp_replace(
 CASE WHEN n >= 10000 THEN substr('零一二三四五六七八九', CAST(n // 10000 + 1 AS INTEGER), 1) || '万' ELSE '' END ||
 CASE WHEN n >= 1000 THEN CASE WHEN n // 1000 % 10 = 0 THEN '零' ELSE substr('零一二三四五六七八九', CAST(n // 1000 % 10 + 1 AS INTEGER), 1) || '千' END ELSE '' END ||
 CASE WHEN n >= 100 THEN CASE WHEN n // 100 % 10 = 0 THEN '零' ELSE substr('零一二三四五六七八九', CAST(n // 100 % 10 + 1 AS INTEGER), 1) || '百' END ELSE '' END ||
 CASE WHEN n >= 10 THEN CASE WHEN n // 10 % 10 = 0 THEN '零' ELSE substr('零一二三四五六七八九', CAST(n // 10 % 10 + 1 AS INTEGER), 1) || '十' END ELSE '' END ||
 substr('零一二三四五六七八九', CAST(n % 10 + 1 AS INTEGER), 1), '零+', '零', 'g'), '零$', ''), '^一十', '十') END AS numeral FROM (SELECT p_partkey, p_partkey * 37 % 100000 AS n FROM part)"""
TITLES = "SELECT p_partkey, ['第' || p_partkey || '章 ' || p_name, '番外：' || p_name, '番外 ' || p_name, '第一卷 ' || p_name, '第2.5话' || p_name][CAST(p_partkey % 5 + 1 AS INTEGER)] AS title FROM part"
EXTRA_TITLE, CHAPTER_TITLE = rf"^番外(?:[：:][{SPACE}]*|[{SPACE}]+)(.+)$", rf"^(第[{TITLE_NUMERAL}]+[章话回节])[{SPACE}]+(.+)$"
VOLUME_TITLE = rf"^(第[{NUMERAL}]+[卷部篇集]|番外(?:篇)?)[{SPACE}]*(.*)$"
#: Segments: (work_id, doc_id, seg_no, marker, num, style, rest, line_no).
SEGS = f"SELECT doc_id // 20 AS work_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seg_no, marker, num, style, rest, line_no FROM ({MARKERS})"
SEQ = f"SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY doc_id, seg_no) AS seq FROM ({SEGS})"
PRE = f"SELECT l.doc_id, l.line_no, {strip_sql('l.line')} AS line FROM ({MARKED_LINES}) l LEFT JOIN (SELECT doc_id, min(line_no) AS first FROM ({MARKERS}) GROUP BY doc_id) m ON l.doc_id = m.doc_id WHERE (m.first IS NULL OR l.line_no < m.first) AND {strip_sql('l.line')} <> ''"
SMALL = "['一','二','三','四','五','六','七','八','九']"
SMALL_NUMERAL = f"""CASE WHEN new_num < 10 THEN {SMALL}[CAST(new_num AS INTEGER)] WHEN new_num < 20 THEN '十' || CASE WHEN new_num = 10 THEN '' ELSE {SMALL}[CAST(new_num - 10 AS INTEGER)] END
 WHEN new_num < 100 THEN {SMALL}[CAST(new_num // 10 AS INTEGER)] || '十' || CASE WHEN new_num % 10 = 0 THEN '' ELSE {SMALL}[CAST(new_num % 10 AS INTEGER)] END
 ELSE {SMALL}[CAST(new_num // 100 AS INTEGER)] || '百' || CASE WHEN new_num % 100 = 0 THEN '' WHEN new_num % 100 < 10 THEN '零' || {SMALL}[CAST(new_num % 10 AS INTEGER)] ELSE {SMALL}[CAST(new_num // 10 % 10 AS INTEGER)] || '十' || CASE WHEN new_num % 10 = 0 THEN '' ELSE {SMALL}[CAST(new_num % 10 AS INTEGER)] END END END"""
RENUM = f"""SELECT *, CASE WHEN num IS NOT NULL THEN first_value(num IGNORE NULLS) OVER a + count(num) OVER w - 1 END AS new_num,
 first_value(CASE WHEN num IS NOT NULL THEN style END IGNORE NULLS) OVER a AS first_style FROM ({SEGS})
 WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no), a AS (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
IN_RANGE = f"SELECT c.work_id, c.chapter_key, c.ord, v.vol_no, v.name AS volume FROM ({NUMBERED}) c JOIN ({VOLUMES}) v ON c.work_id = v.work_id AND c.ord BETWEEN v.start AND v.\"end\" WHERE c.ord > 0"
FIRST_VOLUME = f"SELECT work_id, chapter_key, min(ord) AS ord, min(vol_no) AS vol_no, min_by(volume, vol_no) AS volume FROM ({IN_RANGE}) GROUP BY work_id, chapter_key"
HEADINGS = f"SELECT work_id, chapter_key, max_by(volume, vol_no) AS volume FROM (SELECT work_id, vol_no, volume, min_by(chapter_key, ord) AS chapter_key FROM ({IN_RANGE}) GROUP BY work_id, vol_no, volume) GROUP BY work_id, chapter_key"
SPINE = f"""WITH c AS (SELECT n.work_id, n.chapter_key, f.vol_no, f.volume, row_number() OVER (PARTITION BY n.work_id ORDER BY n.ord, n.chapter_key) AS place FROM ({NUMBERED}) n LEFT JOIN ({FIRST_VOLUME}) f ON n.work_id = f.work_id AND n.chapter_key = f.chapter_key),
items AS (SELECT work_id, 'chap' AS kind, chapter_key, vol_no, chapter_key AS title, place, 1 AS after FROM c UNION ALL SELECT work_id, 'vol', NULL, vol_no, volume, min(place), 0 FROM c WHERE vol_no IS NOT NULL GROUP BY work_id, vol_no, volume),
spine AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY place, after, vol_no) AS play_order FROM items)"""
META = "SELECT conv_id, lpad(CAST(turn + 1 AS VARCHAR), 3, '0') AS key, turn, substr(text, 1, 12) AS title, '2020-01-01 00:00:00' AS time, CAST(length(text) AS BIGINT) AS word_count, CASE WHEN turn % 3 = 0 THEN '（暂无简介）' ELSE role END AS \"desc\" FROM conversations"
BODY = f"list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda p: {strip_sql('p')}), lambda p: p <> '')"

REPLACED = "x"
for _c in RESERVED:
    REPLACED = f"replace({REPLACED}, {q(_c)}, '{{}}')"
_UNDER, _BLANK = (REPLACED.replace("{}", c).replace("replace(x", "replace(url", 1) for c in "_ ")


def _status(main: str, extra: str) -> str:
    return f"CASE WHEN {main} = 0 AND {extra} = 0 THEN '未知' ELSE concat_ws('+', CASE WHEN {main} > 0 THEN {main} || '章' END, CASE WHEN {extra} > 0 THEN {extra} || '番外' END) END"


def _info(title: str, author: str, main: str, extra: str, words: str, desc: str, volumes: str = "''") -> str:
    gap = f"{LF} || {LF}"
    lines = ["'书籍信息'", title, f"'作者：' || {author}", "'连载平台：Web'", f"'连载状态：' || {_status(main, extra)} || '（2020年1月2日）' || {volumes}", f"'字数：' || {WAN.format(words)}", "'简介：'", desc]
    return f" || {gap} || ".join(lines) + f" || {LF}"


REFRESHED = _info("c_name", "c_mktsegment", "(c_custkey % 4)", "(c_custkey % 2)", "(c_custkey * 1000)", "'text'", f"CASE WHEN c_custkey % 3 > 0 THEN {LF} || '卷/篇数：' || (c_custkey % 3) ELSE '' END")
ILLUS = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'img' WHEN 2 THEN 'img' ELSE 'line' END AS kind, lpad(CAST(turn + 1 AS VARCHAR), 3, '0') AS header, CASE WHEN turn % 4 = 1 THEN 'i' || turn || '.png' ELSE 'ch7_' || turn || '.png' END AS img, role FROM conversations"
TAG_TEXT = "SELECT doc_id, text AS head, doc_id % 50 AS a, doc_id % 7 AS b FROM documents"


def _tag(n: str) -> str:
    gap, known = f"{LF} || {LF}", f"{n} IN (SELECT DISTINCT doc_id % 45 FROM documents)"
    said = f"CASE {n} % 4 WHEN 0 THEN '【插图: p' || {n} || '.jpg】' WHEN 1 THEN '【插图失效: 原图 ' || {n} || ' 已删除】' WHEN 2 THEN '【插图获取失败: 原图 ' || {n} || ' 请求超时或网络异常】' ELSE '【插图获取失败: 原图 ' || {n} || ' 返回数据异常】' END"
    return f"CASE WHEN {known} THEN {gap} || {said} || {gap} ELSE '[image:' || {n} || ']' END"


PAGE_ITEMS = f"""{SPINE}, bodies AS (SELECT {WORK} AS work_id, {PAD} AS chapter_key, CAST(doc_id AS VARCHAR) AS title, list_filter({BODY}, lambda p: true) AS p FROM documents),
pages AS (SELECT s.work_id, s.kind, s.play_order, coalesce(b.title, s.title) AS title, list_transform(coalesce(b.p, []), lambda x: '<p>' || {ESCAPE.format('x')} || '</p>') AS f FROM spine s LEFT JOIN bodies b ON s.work_id = b.work_id AND s.chapter_key = b.chapter_key),
html AS (SELECT work_id, CASE kind WHEN 'vol' THEN 'vol_' ELSE 'chap_' END || lpad(CAST(play_order AS VARCHAR), 5, '0') || '.xhtml' AS page_name, title,
'<?xml version="1.0" encoding="utf-8"?>' || {LF} || '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || {ESCAPE.format('title')} || '</title><link rel="stylesheet" href="style.css"/></head><body>' || {LF} || '<h1>' || {ESCAPE.format('title')} || '</h1>' || {LF} || coalesce(list_aggregate(f, 'string_agg', {LF}), '') || {LF} || '</body></html>' || {LF} AS page_html FROM pages)"""

NEW_TITLE = f"CASE WHEN num IS NULL THEN marker ELSE '第' || CASE WHEN first_style = 'chinese' THEN {SMALL_NUMERAL} ELSE CAST(new_num AS VARCHAR) END || '章' || CASE WHEN rest <> '' AND NOT regexp_matches(rest, '^[\\s：:]') THEN ' ' ELSE '' END || rest END"

EDITED = f"CASE WHEN doc_id % 3 = 0 THEN replace(text, 'en', 'EN') || {LF} || 'z' WHEN doc_id % 3 = 1 THEN string_split(text, {LF})[1] ELSE text END"
#: Paragraph lists a and b side by side: line numbers with differences, and the first differing place of two texts.
CHANGED = "list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])"
PLACE = "list_position(list_transform(list_zip(string_split(a[i], ''), string_split(b[i], '')), lambda c: c[1] IS DISTINCT FROM c[2]), true)"
AT = "coalesce(nullif(substr({}[i], {}, 1), ''), '(无)')"
COMPARE_REPORT = f"""SELECT doc_id, CAST(length(r) AS BIGINT) AS n_chars, md5(r) AS report_md5 FROM (SELECT doc_id, '文件1和文件2之间的差异：' || {LF} || {LF} ||
 coalesce(array_to_string(list_transform(c, lambda i, k: '第 ' || k || ' 个错误：' || {LF} || '文件1第 ' || i || ' 行：' || {LF} || a[i] || {LF} || '文件2第 ' || i || ' 行：' || {LF} || b[i] || {LF} || '第一个不同的字符在位置 ' || {PLACE} || '，''' || {AT.format('a', PLACE)} || ''' vs ''' || {AT.format('b', PLACE)} || '''，这段共有 1 个错误' || {LF} || {LF}), ''), '') ||
 '总共 ' || (len(c) + abs(len(a) - len(b))) || ' 处错误' ||
 coalesce(array_to_string(list_transform(range(len(b) + 1, len(a) + 1), lambda i: '文件1额外的行 ' || i || '：''' || a[i] || '''' || {LF}), ''), '') ||
 coalesce(array_to_string(list_transform(range(len(a) + 1, len(b) + 1), lambda i: '文件2额外的行 ' || i || '：''' || b[i] || '''' || {LF}), ''), '') AS r
 FROM (SELECT *, {CHANGED} AS c FROM (SELECT doc_id, {paragraphs_sql('text')} AS a, {paragraphs_sql(EDITED)} AS b FROM documents)))"""


def _section(s: int, head: str, tail: str) -> str:
    these = f"FILTER (section = {s})"
    return f"CASE WHEN count(*) {these} > 0 THEN {LF} || '{head}' || count(*) {these} || '{tail}' || {LF} || string_agg(line, {LF} ORDER BY CAST(chapter_key AS BIGINT)) {these} || {LF} ELSE '' END"


def _more(rows: str, rest: str) -> str:
    return f"CASE WHEN len({rows}) > 3 THEN {LF} || '    ... 剩余 ' || (len({rows}) - 3) || ' {rest}见日志文件' ELSE '' END"


def _surplus(rows: str, x: str, did: str, side: str) -> str:
    return f"CASE WHEN len({rows}) > 0 THEN {LF} || '  校正版{did}了 ' || len({rows}) || ' 段:' || array_to_string(list_transform({rows}[1:3], lambda i: {LF} || '    第 ' || i || ' 段 ({side}独有): ' || {x}[i]), '') || {_more(rows, '段' + did)} ELSE '' END"


DIRECTORY_REPORT = f"""WITH p AS (SELECT coalesce(x.work_id, y.work_id) AS work_id, coalesce(x.chapter_key, y.chapter_key) AS chapter_key, x.file_name AS bn, y.file_name AS cn, {paragraphs_sql('x.text')} AS a, {paragraphs_sql('y.text')} AS b FROM ({BASE}) x FULL JOIN ({COR}) y ON x.chapter_key = y.chapter_key),
c AS (SELECT *, {CHANGED} AS c, range(len(b) + 1, len(a) + 1) AS gone, range(len(a) + 1, len(b) + 1) AS added FROM p),
s AS (SELECT *, CASE WHEN cn IS NULL THEN 4 WHEN bn IS NULL THEN 5 WHEN len(c) + len(gone) + len(added) > 0 THEN 0 WHEN bn <> cn THEN 1 ELSE 6 END AS section FROM c),
l AS (SELECT work_id, chapter_key, section, CASE section
 WHEN 0 THEN {LF} || '===== [' || chapter_key || '] ' || bn || CASE WHEN bn <> cn THEN '  vs  ' || cn ELSE '' END || ' — ' || (len(c) + len(gone) + len(added)) || ' 处差异 =====' ||
  coalesce(array_to_string(list_transform(c[1:3], lambda i: {LF} || '  第 ' || i || ' 段 第 ' || {PLACE} || ' 字: ''' || {AT.format('a', PLACE)} || ''' vs ''' || {AT.format('b', PLACE)} || '''' || {LF} || '    标准化: ' || a[i] || {LF} || '    校正版: ' || b[i]), ''), '') || {_more('c', '处段落差异')} || {_surplus('gone', 'a', '删除', '标准化')} || {_surplus('added', 'b', '新增', '校正')}
 WHEN 1 THEN '  [' || chapter_key || '] ' || bn || '  ->  ' || cn ELSE '  [' || chapter_key || '] ' || coalesce(bn, cn) END AS line FROM s),
r AS (SELECT work_id, {_section(0, '', ' 个配对文件发现内容差异：')} || {_section(1, '', ' 个文件仅改了文件名（内容一致）:')} || CASE WHEN count(*) FILTER (section < 2) = 0 THEN {LF} || '所有配对文件内容完全一致，无差异。' || {LF} ELSE '' END || {_section(4, '仅标准化目录存在 ', ' 个文件（未校正）:')} || {_section(5, '仅校正目录存在 ', ' 个文件（新增）:')} ||
 {LF} || '对比完成: ' || count(*) FILTER (section = 0) || ' 篇改动，' || count(*) FILTER (section IN (1, 6)) || ' 篇未改（其中 ' || count(*) FILTER (section = 1) || ' 篇仅改名），' || count(*) FILTER (section = 4) || ' 篇未校正，' || count(*) FILTER (section = 5) || ' 篇新增' || {LF} AS r FROM l GROUP BY work_id)
SELECT work_id, CAST(length(r) AS BIGINT) AS n_chars, md5(r) AS report_md5 FROM r"""
TURN = "lpad(CAST(turn AS VARCHAR), 3, '0')"
GOT = f"SELECT *, {WORK} AS work_id, {PAD} AS num FROM documents WHERE doc_id % 9 <> 0"
_NOTICE = f"{LF} || {LF} || '【' || {{}} || '】' || {LF} || {LF}"
_REFERENCED = [_NOTICE.format(x) for x in ("'插图: ch' || num || '_pid_0.jpg'", "'插图失效: 原图 1 已删除'", "'插图获取失败: 原图 2 请求超时或网络异常'", "'插图获取失败: 原图 3 返回数据异常'")]
_UPLOADED = _NOTICE.format("'插图: ch' || num || '_up_5.png'")
DOWNLOADED = f"'a' || {LF} || {LF} || 'b' || {_UPLOADED} || CASE doc_id % 4 WHEN 0 THEN {_REFERENCED[0]} WHEN 1 THEN {_REFERENCED[1]} WHEN 2 THEN {_REFERENCED[2]} ELSE {_REFERENCED[3]} END || text || '[uploadedimage:6][image:9]'"


INFO_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>书籍信息</title><link rel="stylesheet" href="style.css"/></head><body class="book-info-page">\n<h1 class="book-info-title">书籍信息</h1>\n'

ORACLE_SQL: dict[str, str] = {
    "line_explode_nonblank": f"SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM ({PARAS})",
    "paragraph_interleave": f"SELECT doc_id, CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(p, {LF} || {LF}) || {LF} END AS text FROM ({PARAS})",
    "paragraph_indent": f"SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i > 1 THEN chr(12288) || chr(12288) ELSE '' END || x), {LF}) AS text FROM ({PARAS})",
    "char_count_by_lang": f"SELECT lang, count(*) AS n_docs, CAST(sum(n_paras) AS BIGINT) AS n_paras, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM ({COUNTED}) GROUP BY lang",
    "word_count_wan": f"SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, {WAN.format('n_chars')} AS wan FROM ({COUNTED})",
    "punct_convert_file_scope": f"SELECT doc_id, {PAIRED.format(x=WIDE.format('text'))} AS text FROM ({QUOTED})",
    "punct_convert_line_scope": f"SELECT doc_id, string_agg({PAIRED.format(x='l')}, {LF} ORDER BY k) AS text FROM (SELECT doc_id, unnest(string_split({WIDE.format('text')}, {LF})) AS l, unnest(range(len(string_split({WIDE.format('text')}, {LF})))) AS k FROM ({QUOTED})) GROUP BY doc_id",
    "punct_stats": f"SELECT doc_id, CAST(o AS BIGINT) AS original_quote, CAST((o + 1) // 2 AS BIGINT) AS front_quote, CAST(o // 2 AS BIGINT) AS back_quote, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS original_exclamation, CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS original_question, CAST(o % 2 AS BIGINT) AS unpaired FROM (SELECT doc_id, text, length(text) - length(replace(text, '\"', '')) AS o FROM ({QUOTED}))",
    "html_clean": f"SELECT page_id, {strip_sql('''replace(replace(replace(regexp_replace(replace(replace(coalesce(html, ''), '<br />', chr(10)), '<br>', chr(10)), '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')''')} AS text FROM pages",
    "html_escape": f"SELECT doc_id, {ESCAPE.format('text')} AS text FROM ({QUOTED})",
    "filename_sanitize": f"SELECT page_id, {strip_sql(_BLANK)} AS spaced, {_UNDER} AS cleaned FROM pages",
    "timestamp_trim_date_cn": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS date_cn FROM orders",
    "page_break_replace": f"SELECT doc_id, replace(replace(text, '. ', '.[newpage]'), '[newpage]', {LF} || {LF}) AS text FROM documents",
    "media_type_of_url": "SELECT page_id, CASE page_id % 5 " + f"WHEN 0 THEN {q(MEDIA_TYPES['png'])} WHEN 2 THEN {q(MEDIA_TYPES['gif'])} ELSE {q(MEDIA_TYPES['jpeg'])} END AS media_type FROM pages",
    "first_difference": f"SELECT x.work_id, x.chapter_key, i AS pos, substr(x.text, i, 1) AS char1, substr(y.text, i, 1) AS char2 FROM (SELECT x.work_id, x.chapter_key, x.text, y.text AS other, list_position(list_transform(list_zip(string_split(x.text, ''), string_split(y.text, '')), lambda c: c[1] <> c[2]), true) AS i FROM ({BASE}) x JOIN ({COR}) y ON x.chapter_key = y.chapter_key WHERE x.text <> y.text) x JOIN ({COR}) y ON x.chapter_key = y.chapter_key",
    "int_to_chinese": NUMERAL_SQL,
    "chinese_to_int": "SELECT p_partkey, nullif(p_partkey * 37 % 100000, 0) AS value FROM part",
    "title_split": f"SELECT p_partkey, CASE WHEN regexp_matches(title, {q(EXTRA_TITLE)}) THEN '番外' WHEN regexp_matches(title, {q(CHAPTER_TITLE)}) THEN regexp_extract(title, {q(CHAPTER_TITLE)}, 1) END AS num, CASE WHEN regexp_matches(title, {q(EXTRA_TITLE)}) THEN {strip_sql(f'regexp_extract(title, {q(EXTRA_TITLE)}, 1)')} WHEN regexp_matches(title, {q(CHAPTER_TITLE)}) THEN {strip_sql(f'regexp_extract(title, {q(CHAPTER_TITLE)}, 2)')} ELSE title END AS name FROM ({TITLES})",
    "volume_title_split": f"SELECT p_partkey, CASE WHEN r <> '' THEN regexp_extract(title, {q(VOLUME_TITLE)}, 1) END AS num, CASE WHEN r <> '' THEN r ELSE title END AS name FROM (SELECT *, {strip_sql(f'regexp_extract(title, {q(VOLUME_TITLE)}, 2)')} AS r FROM ({TITLES}))",
    "chapter_name_only": f"SELECT p_partkey, CASE WHEN n = '' THEN s ELSE n END AS name FROM (SELECT p_partkey, title AS s, regexp_replace(title, {q(rf'^第[{NUMERAL}]+[章话节回][{SPACE}]*[：:]?[{SPACE}]*')}, '') AS n FROM ({TITLES}))",
    "prefix_extract_sort": f"SELECT doc_id, file_name, prefix, chapter_key, row_number() OVER (PARTITION BY work_id ORDER BY prefix IS NULL, {ORD}, chapter_key, doc_id) AS place, row_number() OVER (PARTITION BY work_id ORDER BY coalesce({ORD}, 0), file_name, doc_id) AS format_place FROM ({CHAPTERS})",
    "prefix_conflict_winner": f"SELECT doc_id // 40 AS work_id, chapter_key, max(file_name) AS file_name FROM ({CHAPTERS}) GROUP BY 1, 2",
    "diff_status_summary": f"{STATUS} SELECT status, count(*) AS n_files, CAST(sum(n_diffs) AS BIGINT) AS n_diffs FROM s GROUP BY status",
    "diff_paragraphs": f"{DIFFS} SELECT chapter_key, line_no, kind, CASE WHEN kind = 'changed' THEN pos END AS pos, CASE WHEN kind = 'changed' THEN coalesce(nullif(substr(text1, pos, 1), ''), '(无)') END AS char1, CASE WHEN kind = 'changed' THEN coalesce(nullif(substr(text2, pos, 1), ''), '(无)') END AS char2, text1, text2, CASE WHEN kind = 'changed' THEN line_no ELSE line_no + shorter END AS compat_line_no FROM e",
    "diff_preview_topk": f"{DIFFS} SELECT chapter_key, line_no, rank, greatest(total - 3, 0) AS remaining FROM (SELECT chapter_key, line_no, row_number() OVER (PARTITION BY chapter_key ORDER BY line_no) AS rank, count(*) OVER (PARTITION BY chapter_key) AS total FROM e) WHERE rank <= 3",
    "diff_report": f"{STATUS} SELECT work_id, string_agg('[' || status || '] ' || file_name || CASE WHEN n_diffs > 0 THEN ' (' || n_diffs || ')' ELSE '' END, {LF} ORDER BY chapter_key) AS report FROM s GROUP BY work_id",
    "assemble_overlay_lineage": f"SELECT coalesce(x.work_id, y.work_id) AS work_id, coalesce(x.chapter_key, y.chapter_key) AS chapter_key, coalesce(y.file_name, x.file_name) AS file_name, md5(CASE WHEN y.chapter_key IS NOT NULL THEN y.text ELSE x.text END) AS text_md5, CASE WHEN y.chapter_key IS NOT NULL THEN 'corrected' ELSE 'baseline' END AS origin, coalesce(x.file_name <> y.file_name, false) AS renamed, x.file_name AS replaces FROM ({BASE}) x FULL JOIN ({COR}) y ON x.chapter_key = y.chapter_key",
    "assemble_summary": f"SELECT count(*) AS total, count(y.chapter_key) AS from_corrected, count(*) - count(y.chapter_key) AS from_baseline, count(*) FILTER (x.file_name <> y.file_name) AS renamed FROM ({BASE}) x FULL JOIN ({EXTRA}) y ON x.chapter_key = y.chapter_key",
    "overlay_three_layers": f"SELECT work_id, chapter_key, file_name, CAST(layer_rank AS BIGINT) AS layer_rank, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY chapter_key ORDER BY layer_rank DESC) AS n FROM (SELECT *, 0 AS layer_rank FROM ({BASE}) UNION ALL SELECT *, 1 FROM ({COR}) UNION ALL SELECT *, 2 FROM ({EXTRA}))) WHERE n = 1",
    "assemble_conflicts": f"SELECT coalesce(x.work_id, y.work_id) AS work_id, coalesce(x.chapter_key, y.chapter_key) AS chapter_key, coalesce(y.file_name, x.file_name) AS file_name, md5(coalesce(y.text, x.text)) AS text_md5, CASE WHEN y.chapter_key IS NOT NULL THEN 'corrected' ELSE 'baseline' END AS origin, x.file_name AS replaces FROM ({_last(conflicting_sql(2))}) x FULL JOIN ({_last(conflicting_sql(3))}) y ON x.work_id = y.work_id AND x.chapter_key = y.chapter_key",
    "merge_command": f"""WITH l AS (SELECT work_id, chapter_key, file_name, text, 0 AS layer_rank FROM ({MERGE_BASE}) UNION ALL SELECT work_id, chapter_key, file_name, text, 1 FROM ({MERGE_FIX})),
w AS (SELECT *, {paragraphs_sql('text')} AS p, try_cast(chapter_key AS BIGINT) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY work_id, chapter_key ORDER BY layer_rank DESC, file_name DESC) AS n FROM l) WHERE n = 1),
t AS (SELECT work_id, string_agg(CASE WHEN len(p) > 0 THEN array_to_string(p, {LF} || {LF}) || {LF} || {LF} ELSE '' END, '' ORDER BY ord IS NULL, ord, chapter_key) AS text FROM w GROUP BY work_id)
SELECT work_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM t""",
    "split_punct": f"""WITH s AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next, row_number() OVER (PARTITION BY work_id ORDER BY doc_id, seg_no) AS seq, {NEW_TITLE} AS title FROM ({RENUM.replace(MARKED_LINES, QUOTED_LINES)})), l AS (SELECT * FROM ({QUOTED_LINES})),
c AS (SELECT s.work_id, s.seq, {WIDE.format("s.title || " + LF + " || coalesce(string_agg(l.line, " + LF + " ORDER BY l.line_no), '')")} AS x FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND l.line_no > s.line_no AND (s.next IS NULL OR l.line_no < s.next) GROUP BY s.work_id, s.seq, s.title)
SELECT work_id, seq, md5({PAIRED.format(x='x')}) AS content_md5 FROM c""",
    "missing_chapters": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "existing_chapters": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "key_intersect": f"SELECT chapter_key FROM ({BASE}) INTERSECT SELECT chapter_key FROM ({COR})",
    "key_except": f"SELECT chapter_key FROM ({BASE}) EXCEPT SELECT chapter_key FROM ({COR})",
    "key_union": f"SELECT chapter_key FROM ({BASE}) UNION SELECT chapter_key FROM ({COR})",
    "marker_detect": f"SELECT doc_id, line_no, marker, num, style FROM ({MARKERS})",
    "segment_chapters": f"""WITH s AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM ({SEGS})), l AS (SELECT * FROM ({MARKED_LINES}))
SELECT s.doc_id, s.seg_no, s.marker, s.num, md5(coalesce(string_agg(l.line, {LF} ORDER BY l.line_no), '')) AS body_md5 FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND l.line_no > s.line_no AND (s.next IS NULL OR l.line_no < s.next) GROUP BY s.doc_id, s.seg_no, s.marker, s.num""",
    "segment_renumber": f"SELECT doc_id, seg_no, {NEW_TITLE} AS title, new_num, coalesce(new_num <> num, false) AS fixed FROM ({RENUM})",
    "chapter_files_written": f"""WITH s AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next, row_number() OVER (PARTITION BY work_id ORDER BY doc_id, seg_no) AS seq, {NEW_TITLE} AS title FROM ({RENUM})), l AS (SELECT * FROM ({MARKED_LINES})),
b AS (SELECT s.work_id, s.seq, s.title, coalesce(string_agg(l.line, {LF} ORDER BY l.line_no), '') AS body FROM s LEFT JOIN l ON s.doc_id = l.doc_id AND l.line_no > s.line_no AND (s.next IS NULL OR l.line_no < s.next) GROUP BY s.work_id, s.seq, s.title)
SELECT work_id, seq, lpad(CAST(seq AS VARCHAR), CAST(greatest(3, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') || ' ' || {strip_sql(REPLACED.replace("{}", " ").replace("replace(x", "replace(title", 1))} || '.txt' AS file_name, title, md5(body) AS body_md5 FROM b""",
    "global_sequence": f"SELECT doc_id, seg_no, seq FROM ({SEQ})",
    "volume_ranges": f"SELECT work_id, regexp_replace(CAST(doc_id AS VARCHAR), '^\\d+[ ]*', '') AS name, min(seq) AS start, max(seq) AS \"end\" FROM ({SEQ}) GROUP BY work_id, doc_id",
    "segment_preambles": f"SELECT doc_id // 20 AS work_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({PRE}) GROUP BY 1",
    "split_run_stats": f"SELECT s.work_id, s.chapters, s.fixed, coalesce(p.n, 0) AS preamble_files FROM (SELECT work_id, count(*) AS chapters, count(*) FILTER (new_num <> num) AS fixed FROM ({RENUM}) GROUP BY work_id) s LEFT JOIN (SELECT doc_id // 20 AS work_id, count(DISTINCT doc_id) AS n FROM ({PRE}) GROUP BY 1) p ON s.work_id = p.work_id",
    "main_extra_numbering": f"""SELECT doc_id, CASE WHEN e THEN 'extra' ELSE 'main' END AS kind, CASE WHEN NOT e THEN new_num END AS number,
CASE WHEN NOT e THEN '第' || {SMALL_NUMERAL} || '章 ' || plain WHEN bare = '' THEN '番外' ELSE '番外：' || bare END AS display
FROM (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY work_id ORDER BY {ORD}, file_name ROWS UNBOUNDED PRECEDING) AS new_num, {strip_sql("replace(replace(plain, '番外：', ''), '番外', '')")} AS bare
FROM (SELECT *, contains(plain, '番外') AS e FROM (SELECT *, {strip_sql("regexp_replace(regexp_extract(file_name, '^([0-9]+)[ ]+(.*?)[.]txt$', 2), '^第[一二三四五六七八九十百千万零两0-9]+章[ ]*', '')")} AS plain FROM ({CHAPTERS}) WHERE prefix IS NOT NULL AND {ORD} <> 0)))""",
    "first_line_title": f"""WITH l AS (SELECT doc_id, line_no, {strip_sql('line')} AS s FROM ({MARKED_LINES})), f AS (SELECT doc_id, min(line_no) AS line_no, count(*) AS n FROM l WHERE s <> '' GROUP BY doc_id)
SELECT f.doc_id, coalesce(m.marker, 'T' || f.doc_id) AS display_title, m.marker IS NOT NULL AS skip_first, n - CASE WHEN m.marker IS NOT NULL THEN 1 ELSE 0 END AS n_fragments FROM f LEFT JOIN ({MARKERS}) m ON f.doc_id = m.doc_id AND f.line_no = m.line_no""",
    "main_extra_counts": f"SELECT work_id, count(*) FILTER (NOT contains(file_name, '番外')) AS n_main, count(*) FILTER (contains(file_name, '番外')) AS n_extra FROM ({CHAPTERS}) WHERE NOT starts_with(file_name, '000 ') GROUP BY work_id",
    "volume_assign_first": f"SELECT work_id, chapter_key, CAST(vol_no AS BIGINT) AS vol_no, volume FROM ({FIRST_VOLUME})",
    "volume_heading_first": HEADINGS,
    "spine_play_order": f"{SPINE} SELECT work_id, kind, title, play_order, CASE WHEN kind = 'chap' AND vol_no = last_vol THEN last_order END AS parent FROM (SELECT *, last_value(CASE WHEN kind = 'vol' THEN vol_no END IGNORE NULLS) OVER w AS last_vol, last_value(CASE WHEN kind = 'vol' THEN play_order END IGNORE NULLS) OVER w AS last_order FROM spine WINDOW w AS (PARTITION BY work_id ORDER BY play_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "volume_overlaps": f"SELECT work_id, name, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM (SELECT *, max(\"end\") OVER (PARTITION BY work_id ORDER BY start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({VOLUMES})) WHERE start <= reach",
    "merged_text": f"""SELECT work_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT c.work_id, string_agg(CASE WHEN h.volume IS NOT NULL THEN {LF} || h.volume || {LF} || {LF} ELSE '' END ||
CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(CASE WHEN ord = 0 THEN p ELSE list_transform(p, lambda x, i: CASE WHEN i > 1 THEN chr(12288) || chr(12288) ELSE '' END || x) END, {LF} || {LF}) || {LF} || {LF} END, '' ORDER BY ord, c.chapter_key) AS t
FROM (SELECT {WORK} AS work_id, {PAD} AS chapter_key, doc_id % 20 AS ord, {BODY} AS p FROM documents) c LEFT JOIN ({HEADINGS}) h ON c.work_id = h.work_id AND c.chapter_key = h.chapter_key GROUP BY c.work_id)""",
    "epub_pages": f"{PAGE_ITEMS} SELECT work_id, page_name, title, CAST(length(page_html) AS BIGINT) AS n_chars, md5(page_html) AS page_md5 FROM html",
    "records_upsert": "WITH o AS (SELECT conv_id, turn, role || '-' || turn AS id FROM conversations), n AS (SELECT conv_id, turn + 1 AS turn, 'new-' || role || '-' || turn AS id FROM conversations WHERE turn % 2 = 1) SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, lpad(CAST(coalesce(o.turn, n.turn) AS VARCHAR), 3, '0') AS chapter_num, coalesce(n.id, o.id) AS novel_id FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn",
    "metadata_word_total": f"SELECT conv_id, CAST(sum(word_count) AS BIGINT) AS word_count, count(*) FILTER (contains(title, 'th')) AS n_extra, count(*) AS n_chapters FROM ({META}) GROUP BY conv_id",
    "summary_render": f"SELECT conv_id, string_agg(key || ' ' || title || ' ' || time || ' 字数: ' || word_count || {LF} || \"desc\" || {LF} || {LF}, '' ORDER BY turn) AS summary FROM ({META}) GROUP BY conv_id",
    "metadata_json_roundtrip": f"SELECT conv_id, key, title, word_count, \"desc\" FROM ({META})",
    "metadata_json_text": f"""SELECT conv_id, md5('{{' || string_agg('"' || key || '":' || to_json(struct_pack(title := title, time := time, word_count := word_count, "desc" := "desc")), ',' ORDER BY key) || '}}') AS json_md5 FROM ({META}) GROUP BY conv_id""",
    "chapter_selection": "SELECT conv_id AS work_id, turn + 1 AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 10 AS running, turn + 1 AS kept FROM conversations WHERE turn + 1 BETWEEN 2 AND 4",
    "newest_info_argmax": "SELECT event_type, f AS file_name FROM (SELECT event_type, lpad(CAST(event_id AS VARCHAR), 10, '0') AS f, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "json_props_extract": "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events",
    "tag_distinct_ordered": f"SELECT doc_id, string_agg(t, '、' ORDER BY k) AS tags, count(*) AS n_tags FROM (SELECT doc_id, t, min(k) AS k FROM (SELECT doc_id, {strip_sql('unnest(w)')} AS t, unnest(range(len(w))) AS k FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) WHERE t <> '' GROUP BY doc_id, t) GROUP BY doc_id",
    "listing_word_total": "SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber % 3 = 0 OR trunc(l_quantity) = 0 THEN l_linenumber ELSE trunc(l_quantity) END) AS BIGINT) AS words FROM lineitem GROUP BY l_orderkey",
    "success_ratio": "SELECT count(*) FILTER (value > 50) AS n_ok, count(*) AS n_total FROM events",
    "header_forward_fill": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations",
    "illustration_collect": f"WITH i AS (SELECT * FROM ({ILLUS})), e AS (SELECT conv_id, turn, img, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM i WHERE kind = 'img') SELECT e.conv_id, CASE WHEN e.turn % 4 = 2 THEN '007' ELSE (SELECT max(h.header) FROM i h WHERE h.conv_id = e.conv_id AND h.kind = 'head' AND h.turn < e.turn) END AS chapter, e.pos, e.img, CASE WHEN e.turn % 4 = 2 THEN coalesce((SELECT max(l.role) FROM i l WHERE l.conv_id = e.conv_id AND l.kind = 'line' AND l.turn = e.turn + 1), '') ELSE '' END AS \"desc\" FROM e",
    "image_tag_replace": f"SELECT doc_id, head || {_tag('a')} || ' and ' || {_tag('b')} AS text FROM ({TAG_TEXT})",
    "info_page_render": f"SELECT c_custkey, {_info('c_name', '''CASE WHEN c_mktsegment = 'BUILDING' THEN '未填' ELSE c_mktsegment END''', '(c_custkey % 5)', '(c_custkey % 3)', '(c_custkey * 97)', '''未填'''.join([chr(39), chr(39)]))} AS page FROM customer",
    "info_page_refresh": f"SELECT c_custkey, {REFRESHED} AS page FROM customer",
    "info_page_parse": f"SELECT c_custkey, c_name AS title, c_mktsegment AS author, 'Web' AS platform, {_status('(c_custkey % 4)', '(c_custkey % 2)')} || '（2020年1月2日）' AS status, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS VARCHAR) ELSE '' END AS vol_count, {WAN.format('(c_custkey * 1000)')} AS word_count, 'text' AS description FROM customer",
    "series_page_render": f"SELECT c_custkey, '系列ID: ' || c_custkey || {LF} || '系列名称: ' || c_name || {LF} || '作者: ' || CASE WHEN c_mktsegment = 'BUILDING' THEN '未知作者' ELSE c_mktsegment END || {LF} || '更新时间: 未知时间' || {LF} || '总字数: ' || (c_custkey * 3) || {LF} || '章节数: 0' || {LF} || '标签: ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '、x' ELSE '无' END || {LF} || {LF} || '简介:' || {LF} || 'd' AS page FROM customer",
    "series_page_parse": "SELECT c_custkey, c_name AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN '未知作者' ELSE c_mktsegment END AS author, '未知时间' AS update_time, c_custkey * 3 AS word_count, CAST(0 AS BIGINT) AS chapter_count, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ',x' ELSE '无' END AS tags, 'd' AS description FROM customer",
    "volumes_json": f"SELECT work_id, '[' || string_agg('{{\"name\":\"' || name || '\",\"start\":' || a || ',\"end\":' || b || '}}', ',' ORDER BY a) || ']' AS json FROM (SELECT work_id, regexp_replace(CAST(doc_id AS VARCHAR), '^\\d+[ ]*', '') AS name, min(seq) AS a, max(seq) AS b FROM ({SEQ}) GROUP BY work_id, doc_id) GROUP BY work_id",
    "assemble_lineage_text": f"SELECT work_id, string_agg(line, {LF} ORDER BY chapter_key) AS text FROM (SELECT coalesce(x.work_id, y.work_id) AS work_id, coalesce(x.chapter_key, y.chapter_key) AS chapter_key, coalesce(y.file_name, x.file_name) || CASE WHEN y.file_name IS NULL THEN ' <- baseline' ELSE ' <- corrected' END || CASE WHEN x.file_name <> y.file_name THEN ' (was ' || x.file_name || ')' ELSE '' END AS line FROM ({BASE}) x FULL JOIN ({EXTRA}) y ON x.chapter_key = y.chapter_key) GROUP BY work_id",
    "revisions_upsert": "SELECT conv_id, lpad(CAST(turn AS VARCHAR), 3, '0') || CASE WHEN turn % 6 = 0 THEN ' x.txt' ELSE '' END AS key, CASE WHEN turn % 3 = 0 THEN text ELSE 'new' END AS msg, lpad(CAST(turn AS VARCHAR), 3, '0') || ' x.txt' AS filename FROM conversations",
    "preset_resolution": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'none such' ELSE n_name END AS preset, n_nationkey % 4 <> 1 AS known, CASE WHEN n_nationkey % 4 > 1 THEN n_nationkey || 'em' ELSE '2.5em' END AS vol_size, CASE WHEN n_nationkey % 5 = 0 THEN 'red' ELSE '#8B0000' END AS vol_color, n_nationkey % 4 <= 1 OR n_nationkey % 3 = 0 AS vol_split FROM nation",
    "compare_report": COMPARE_REPORT,
    "directory_report": DIRECTORY_REPORT,
    "revisions_remove": f"SELECT conv_id, CASE WHEN turn % 2 = 0 THEN {TURN} || ' x.txt' ELSE {TURN} END AS key, role AS msg FROM conversations WHERE turn % 3 <> 0",
    "notes_added": f"SELECT conv_id, {TURN} AS key, text AS msg, CASE WHEN turn % 2 = 1 OR turn % 5 <> 0 THEN {TURN} || ' ' || role || '.txt' ELSE '' END AS filename, CASE WHEN turn % 5 <> 0 THEN CAST(turn AS VARCHAR) WHEN turn % 3 = 0 THEN 't' ELSE '' END AS mtime FROM conversations",
    "work_paths": "SELECT c_custkey, f AS folder, f || '/chapters' AS chapters, f || '/illustrations' AS images, f || '/' || f || '_records.csv' AS records, f || '/' || f || '_metadata.json' AS metadata, f || '/' || f || '_summary.txt' AS summary, f || '/' || f || '_info.txt' AS info, f || '/cover.jpg' AS cover FROM (SELECT c_custkey, 'series_' || c_custkey AS f FROM customer)",
    "series_overview": f"SELECT c_custkey, ok, CASE WHEN NOT ok THEN '' WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE c_name END AS title, CASE WHEN NOT ok THEN '' WHEN c_custkey % 2 = 0 THEN 'U' ELSE 'A' END AS author, CASE WHEN ok THEN 'a' || {LF} || 'b & c' ELSE '' END AS description, CASE WHEN NOT ok THEN '' WHEN c_custkey % 3 = 1 THEN '2020-01-02' ELSE '2019' END AS update_time, CASE WHEN ok THEN 'x,' || c_mktsegment ELSE '' END AS tags, CASE WHEN ok THEN 'http://h.example/p/' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '.PNG?x=1' ELSE '.bin' END END AS cover_url, CASE WHEN ok THEN CASE WHEN c_custkey % 5 = 0 THEN 'cover.png' ELSE 'cover.jpg' END END AS cover FROM (SELECT *, c_custkey % 7 <> 0 AS ok FROM customer)",
    "download_chapters": f"SELECT work_id, num || ' t ' || doc_id || '.txt' AS file_name, md5({DOWNLOADED}) AS content_md5 FROM ({GOT})",
    "download_metadata": f"SELECT work_id, num AS key, 't/' || doc_id AS title, '2020-01-02 03:04:05' AS time, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE CAST(length(text) + length('a[newpage]b[uploadedimage:5][image:0][uploadedimage:6][image:9]') AS BIGINT) END AS word_count, 'd' || {LF} || 'e' AS \"desc\", CAST(doc_id AS VARCHAR) AS novel_id FROM ({GOT})",
    "download_images": f"SELECT work_id, 'ch' || num || '_up_5.png' AS img, 'http://h.example/i/' || doc_id || '.png' AS url FROM ({GOT}) UNION SELECT work_id, 'ch' || num || '_pid_0.jpg', 'http://h.example/0.jpg' FROM ({GOT}) WHERE doc_id % 4 = 0",
    "candidate_files": "SELECT c_custkey AS work_id, '/w/' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/corrected/illustrations' ELSE '/corrected' END || '/Cover.PNG' AS path FROM customer",
    "volume_config_parse": "SELECT c_custkey AS work_id, k AS pos, CASE k WHEN 0 THEN 'A' ELSE 'B' END AS name, c_custkey + 9 * k AS start, CASE k WHEN 0 THEN c_custkey + 5 ELSE c_custkey + 9 END AS \"end\" FROM customer, (VALUES (0), (1)) v(k) WHERE c_custkey % 11 <> 0",
    "revisions_parse": f"SELECT conv_id, {TURN} AS key, text AS msg, role AS filename, '1' AS mtime, '2' AS updated_at FROM conversations WHERE turn % 7 <> 6",
    "illustration_files": f"SELECT conv_id || '-' || turn AS id, {TURN} AS chapter, 'i' || turn || '.png' AS img, role || '|x' AS \"desc\" FROM conversations",
    "listing_pages": "SELECT l_orderkey AS work_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_suppkey) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS id, CASE WHEN l_linenumber % 2 = 0 OR l_partkey = 0 THEN l_suppkey ELSE l_partkey END AS words FROM lineitem",
    "landed_chapters": "SELECT doc_id AS id, good AND doc_id % 5 <> 0 AS ok, CASE WHEN good THEN lang END AS title, md5(CASE WHEN good THEN text ELSE '' END) AS content_md5, CASE WHEN good AND doc_id % 2 = 0 THEN 'd' ELSE '' END AS description, CASE WHEN good THEN '2020-01-02 03:04:05' ELSE '' END AS time, CASE WHEN NOT good THEN 0 WHEN doc_id % 3 = 0 THEN doc_id ELSE length(text) END AS word_count FROM (SELECT *, doc_id % 10 <> 9 AS good FROM documents)",
    "format_command": f"""SELECT work_id, lpad(CAST(n AS VARCHAR), 3, '0') || ' ' || title || '.txt' AS file_name, md5(array_to_string([title] || list_transform(p, lambda p: {PAIRED.format(x=WIDE.format('p'))}), {LF} || {LF}) || {LF}) AS text_md5 FROM (
SELECT {WORK} AS work_id, doc_id, row_number() OVER w AS k, doc_id % 20 + 1 AS n, '第' || ['一','二','三','四','五','六','七','八','九','十','十一','十二','十三','十四','十五','十六','十七','十八','十九','二十'][CAST(row_number() OVER w AS INTEGER)] || '章 t' || doc_id AS title, {paragraphs_sql("replace(replace(text, ', ', ' \"'), '. ', '?')")} AS p FROM documents WINDOW w AS (PARTITION BY {WORK} ORDER BY doc_id))""",
    "epub_entries": f"{PAGE_ITEMS} SELECT work_id, 'OEBPS/' || page_name AS entry, CAST(octet_length(encode(page_html)) AS BIGINT) AS n_bytes, md5(page_html) AS entry_md5 FROM html UNION ALL SELECT DISTINCT work_id, e, CAST(length(t) AS BIGINT), md5(t) FROM html, (VALUES ('mimetype', 'application/epub+zip'), ('OEBPS/style.css', 'p {{}}')) x(e, t)",
    "epub_info_pages": f"""SELECT c_custkey, 'book_info.xhtml' AS page_name, md5({q(INFO_HEAD)} || array_to_string(list_filter(['<p class="book-info-name">' || c_name || '</p>', '<p>作者：' || c_mktsegment || '</p>', '<p>连载平台：Web</p>', '<p>连载状态：' || {_status("(c_custkey % 4)", "(c_custkey % 2)")} || '（2020年1月2日）</p>', CASE WHEN c_custkey % 3 > 0 THEN '<p>卷/篇数：' || (c_custkey % 3) || '</p>' END, '<p>字数：' || {WAN.format("(c_custkey * 1000)")} || '</p>', '<p>简介：</p>', '<p>text</p>'], lambda x: x IS NOT NULL), {LF}) || {LF} || '</body></html>' || {LF}) AS page_md5 FROM customer""",
    "import_tasks": "SELECT lpad(CAST(doc_id % 40 + 1 AS VARCHAR), 3, '0') AS chapter_num, CAST(doc_id AS VARCHAR) AS novel_id FROM documents WHERE doc_id % 40 + 1 NOT IN (SELECT doc_id % 40 FROM labels WHERE doc_id % 40 % 3 = 0)",
    "catalog_render": f"SELECT n_regionkey AS owner, string_agg(n_nationkey || ',' || CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN contains(n_name, ',') OR contains(n_name, '\"') THEN '\"' || replace(n_name, '\"', '\"\"') || '\"' ELSE n_name END ELSE 'old' END || {LF}, '' ORDER BY n_nationkey) AS csv FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 GROUP BY n_regionkey",
    "info_fallback": "SELECT c_custkey AS work_id, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'S' ELSE '未填' END AS title, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'B' ELSE '未填' END AS author FROM customer",
    "stream_upsert": "SELECT conv_id, role, max_by(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id, role",
}
ORACLE_SQL["illustration_totals"] = f"SELECT conv_id, count(*) AS n_images, CAST(count(*) FILTER (\"desc\" <> '') AS BIGINT) AS n_lines, count(DISTINCT chapter) AS n_chapters FROM ({ORACLE_SQL['illustration_collect']}) GROUP BY conv_id"
_EVENTS = "SELECT CAST(conv_id AS VARCHAR) AS work_id, role AS chapter_key, CASE length(text) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS rank, turn * 3 + CASE length(text) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS o FROM conversations"
#: Events of each chapter in order: where it is done, how it began, and its failures before that.
_RESUMED = f"""e AS ({_EVENTS}), k AS (SELECT work_id, chapter_key, min(o) FILTER (rank = 2) AS done_at, arg_min(rank, o) AS first_rank FROM e GROUP BY ALL),
f AS (SELECT e.work_id, e.chapter_key, row_number() OVER (PARTITION BY e.work_id, e.chapter_key ORDER BY o) AS n FROM e JOIN k ON e.work_id = k.work_id AND e.chapter_key = k.chapter_key WHERE rank = 1 AND (done_at IS NULL OR o < done_at))"""
ORACLE_SQL["stream_resume"] = f"WITH {_RESUMED} SELECT work_id, chapter_key, CAST(least(n + 1, 3) AS INTEGER) AS attempt, CASE WHEN n < 3 THEN 'fetch' ELSE 'given_up' END AS status FROM f WHERE n <= 3 UNION ALL SELECT work_id, chapter_key, 1, 'fetch' FROM k WHERE first_rank = 0"
ORACLE_SQL["resume_states"] = f"WITH {_RESUMED}, c AS (SELECT work_id, chapter_key, count(*) AS n FROM f GROUP BY ALL) SELECT k.work_id, k.chapter_key, done_at IS NOT NULL AND coalesce(n, 0) < 3 AS done, CAST(least(coalesce(n, 0), 3) AS INTEGER) AS failures FROM k LEFT JOIN c ON k.work_id = c.work_id AND k.chapter_key = c.chapter_key"
ORACLE_SQL["stream_listing"] = "SELECT source AS work_id, p // 30 AS page_no, CAST(p % 30 AS INTEGER) AS pos, CAST(doc_id AS VARCHAR) AS id, n_chars AS words FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents WHERE source IS NOT NULL)"


def _chunked(before: str, parts: str, order: str, size: int) -> str:
    """Chunks of parts (work_id, ..., text) in an order: those that begin in one stretch of ``size`` characters."""
    return f"""WITH {before}parts AS ({parts}), placed AS (SELECT work_id, text, sum(length(text)) OVER (PARTITION BY work_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) AS began FROM parts WHERE text <> ''),
g AS (SELECT work_id, began // {size} AS stretch, min(began) AS begins, string_agg(text, '' ORDER BY began) AS t FROM placed GROUP BY work_id, began // {size})
SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY stretch) AS chunk_no, CAST(begins AS BIGINT) AS "offset", CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM g"""


_MERGED = ORACLE_SQL["merged_text"]
#: The inside of string_agg(... ORDER BY ...) in the merged text: one part for each chapter.
_PART, _FROM = _MERGED[_MERGED.index("string_agg(") + len("string_agg(") : _MERGED.index(", '' ORDER BY ord")], _MERGED[_MERGED.index("\nFROM (") : _MERGED.rindex(" GROUP BY c.work_id")]
ORACLE_SQL["merged_chunks"] = _chunked("", f"SELECT c.work_id, ord, c.chapter_key, {_PART} AS text {_FROM}", "ord, chapter_key", 5000)
_LINEAGE = ORACLE_SQL["assemble_lineage_text"]
_LINES = _LINEAGE[_LINEAGE.index("FROM (SELECT") + len("FROM (") : _LINEAGE.rindex(") GROUP BY work_id")]
ORACLE_SQL["lineage_chunks"] = _chunked("", f"SELECT work_id, chapter_key, CASE WHEN row_number() OVER (PARTITION BY work_id ORDER BY chapter_key) > 1 THEN {LF} ELSE '' END || line AS text FROM ({_LINES})", "chapter_key", 100)
_HEADS = " ".join(f"WHEN {k} THEN {LF} || '{a}' || count(*) || '{b}' || {LF}" for k, (a, b) in {0: ("", " 个配对文件发现内容差异："), 1: ("", " 个文件仅改了文件名（内容一致）:"), 4: ("仅标准化目录存在 ", " 个文件（未校正）:"), 5: ("仅校正目录存在 ", " 个文件（新增）:")}.items())
ORACLE_SQL["report_chunks"] = _chunked(
    DIRECTORY_REPORT[len("WITH ") : DIRECTORY_REPORT.index("r AS (SELECT work_id")],
    f"""SELECT work_id, section, 1 AS a, CAST(chapter_key AS BIGINT) AS b, line || {LF} AS text FROM l WHERE section <> 6
UNION ALL SELECT work_id, section, 0, 0, CASE section {_HEADS} END FROM l WHERE section <> 6 GROUP BY work_id, section
UNION ALL SELECT work_id, 3, 0, 0, {LF} || '所有配对文件内容完全一致，无差异。' || {LF} FROM l GROUP BY work_id HAVING count(*) FILTER (section < 2) = 0
UNION ALL SELECT work_id, 6, 0, 0, {LF} || '对比完成: ' || count(*) FILTER (section = 0) || ' 篇改动，' || count(*) FILTER (section IN (1, 6)) || ' 篇未改（其中 ' || count(*) FILTER (section = 1) || ' 篇仅改名），' || count(*) FILTER (section = 4) || ' 篇未校正，' || count(*) FILTER (section = 5) || ' 篇新增' || {LF} FROM l GROUP BY work_id""",
    "section, a, b",
    2000,
)
#: Pages of a book with what navigation needs: whether a chapter stands inside a volume's entry, and whether the next page does.
_NAVIGATION = f"""{PAGE_ITEMS}, named AS (SELECT s.work_id, s.kind, s.play_order, s.vol_no, coalesce(b.title, s.title) AS title, CASE s.kind WHEN 'vol' THEN 'vol_' ELSE 'chap_' END || lpad(CAST(s.play_order AS VARCHAR), 5, '0') || '.xhtml' AS page_name FROM spine s LEFT JOIN bodies b ON s.work_id = b.work_id AND s.chapter_key = b.chapter_key),
led AS (SELECT *, last_value(CASE WHEN kind = 'vol' THEN vol_no END IGNORE NULLS) OVER w AS led_no, max(CASE WHEN kind = 'vol' THEN play_order END) OVER w AS led_at FROM named WINDOW w AS (PARTITION BY work_id ORDER BY play_order)),
outs AS (SELECT *, max(CASE WHEN kind = 'chap' AND vol_no IS DISTINCT FROM led_no THEN play_order END) OVER (PARTITION BY work_id ORDER BY play_order) AS out_at FROM led),
nests AS (SELECT *, kind = 'chap' AND led_at IS NOT NULL AND vol_no IS NOT DISTINCT FROM led_no AND coalesce(out_at, 0) < led_at AS inside, {ESCAPE.format('title')} AS shown FROM outs),
points AS (SELECT *, coalesce(lead(inside) OVER (PARTITION BY work_id ORDER BY play_order), false) AS more FROM nests)"""
_HEAD = "'<?xml version=\"1.0\" encoding=\"utf-8\"?>' || chr(10)"
_PACKAGE = {
    "OEBPS/content.opf": """'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:quire:' || work_id || '</dc:identifier><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:language>zh</dc:language><meta property="dcterms:modified">2020-01-01T00:00:00Z</meta></metadata><manifest><item id="css" href="style.css" media-type="text/css"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' || string_agg('<item id="p' || (play_order - 1) || '" href="' || page_name || '" media-type="application/xhtml+xml"/>', '' ORDER BY play_order) || '</manifest><spine toc="ncx">' || string_agg('<itemref idref="p' || (play_order - 1) || '"/>', '' ORDER BY play_order) || '</spine></package>'""",
    "OEBPS/toc.ncx": """'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="urn:quire:' || work_id || '"/></head><docTitle><text>T</text></docTitle><navMap>' || string_agg('<navPoint id="n' || play_order || '" playOrder="' || play_order || '"><navLabel><text>' || shown || '</text></navLabel><content src="' || page_name || '"/>' || CASE WHEN kind = 'chap' THEN '</navPoint>' ELSE '' END || CASE WHEN (kind = 'vol' OR inside) AND NOT more THEN '</navPoint>' ELSE '' END, '' ORDER BY play_order) || '</navMap></ncx>'""",
    "OEBPS/nav.xhtml": """'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>T</title></head><body><nav epub:type="toc"><ol>' || string_agg('<li><a href="' || page_name || '">' || shown || '</a>' || CASE WHEN kind = 'chap' THEN '</li>' WHEN more THEN '<ol>' ELSE '</li>' END || CASE WHEN inside AND NOT more THEN '</ol></li>' ELSE '' END, '' ORDER BY play_order) || '</ol></nav></body></html>'""",
}
_CONTAINER = "'<container version=\"1.0\" xmlns=\"urn:oasis:names:tc:opendocument:xmlns:container\"><rootfiles><rootfile full-path=\"OEBPS/content.opf\" media-type=\"application/oebps-package+xml\"/></rootfiles></container>'"
ORACLE_SQL["epub_entries"] = f"""{_NAVIGATION}, texts AS (SELECT work_id, 'OEBPS/' || page_name AS entry, page_html AS t FROM html UNION ALL SELECT DISTINCT work_id, e, t FROM html, (VALUES ('mimetype', 'application/epub+zip'), ('OEBPS/style.css', 'p {{}}'), ('META-INF/container.xml', {_HEAD} || {_CONTAINER})) x(e, t)
{' '.join(f"UNION ALL SELECT work_id, '{name}', {_HEAD} || {text} FROM points GROUP BY work_id" for name, text in _PACKAGE.items())})
SELECT work_id, entry, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, md5(t) AS entry_md5 FROM texts"""
_SIZED = "CAST(c_custkey % 7 AS VARCHAR) || 'em'"
ORACLE_SQL["preset_rows"] = f"""SELECT c_custkey, 'chapter' AS section, 'big' AS preset, CASE WHEN c_custkey % 4 = 1 THEN '1.5em' ELSE {_SIZED} END AS size, CASE WHEN c_custkey % 4 = 1 THEN 'left' ELSE 'center' END AS align, c_custkey % 4 <> 1 AND c_custkey % 2 = 0 AS flag, CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE '' END AS "desc" FROM customer WHERE c_custkey % 4 > 0
UNION ALL SELECT c_custkey, 'volume', 'plain', '2.5em', NULL, false, '' FROM customer WHERE c_custkey % 4 > 1"""
_HAS = "(c_custkey % 3 = 1 AND c_custkey % 4 > 0)"
ORACLE_SQL["preset_choices"] = f"""SELECT c_custkey, [NULL, 'big', 'odd'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS preset, c_custkey % 3 = 0 OR {_HAS} AS known, CASE WHEN c_custkey % 5 = 0 THEN '9em' WHEN {_HAS} AND c_custkey % 4 > 1 THEN {_SIZED} ELSE '1.5em' END AS size, CASE WHEN c_custkey % 5 = 0 THEN 'red' ELSE '' END AS color,
CASE WHEN {_HAS} AND c_custkey % 4 = 1 THEN 'left' ELSE 'center' END AS align, {_HAS} AND c_custkey % 4 > 1 AND c_custkey % 2 = 0 AS split FROM customer"""
ORACLE_SQL["changed_chapters"] = "SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS chapter_key, CASE WHEN doc_id % 10 = 9 THEN 'new' ELSE 'changed' END AS change, CAST(length(text) + 1 AS BIGINT) AS n_chars, md5(text || '!') AS text_md5 FROM documents WHERE text IS NOT NULL AND doc_id % 10 IN (3, 9)"
ORACLE_SQL["prefix_conflict_files"] = f"SELECT work_id, chapter_key, string_agg(file_name, '|' ORDER BY file_name) AS file_names FROM ({conflicting_sql(3)}) GROUP BY work_id, chapter_key HAVING count(*) > 1"
ORACLE_SQL["records_files"] = "SELECT lpad(CAST(turn AS VARCHAR), 3, '0') AS chapter_num, conv_id || '-' || role AS novel_id FROM conversations WHERE turn % 5 <> 4 AND turn % 7 <> 6"
ORACLE_SQL["catalog_files"] = "SELECT CAST(conv_id AS VARCHAR) AS series_id, arg_max('t' || turn || '-' || role, lpad(CAST(turn AS VARCHAR), 9, '0') || role) AS title FROM conversations GROUP BY conv_id"
ORACLE_SQL["word_count_totals"] = "SELECT l_orderkey, CAST(coalesce(sum(CASE WHEN l_linenumber % 3 = 1 THEN trunc(CAST(l_quantity AS DOUBLE)) END), 0) AS BIGINT) AS words FROM lineitem GROUP BY l_orderkey"
_SHOWN = "'<div class=\"illustration\"><img src=\"img/{}\" alt=\"插图\"/>' || {} || '</div>'"
_PARA = "list_transform(p, lambda x: '<p>' || " + ESCAPE.format("x") + " || '</p>')"
_MARKS = f"replace(text, ', ', '【插图：gone.png】')"
ORACLE_SQL["illustrated_chapters"] = f"""WITH b AS (SELECT doc_id, {paragraphs_sql(_MARKS)} AS p FROM documents), f AS (SELECT doc_id, list_concat(list_concat([{_SHOWN.format('p1.png', "''")}], {_PARA}),
list_concat([CASE WHEN doc_id % 2 = 0 THEN '<p>【插图: p2.png】</p>' ELSE {_SHOWN.format('p2.png', "''")} END], CASE WHEN doc_id % 3 = 0 THEN [{_SHOWN.format('n1.gif', "'<div class=\"illustration-desc\">a&lt;b<br/>' || doc_id || '</div>'")}, {_SHOWN.format('n2.gif', "''")}] ELSE [] END)) AS x FROM b)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_fragments, md5(array_to_string(x, {LF})) AS fragments_md5 FROM f"""
#: Chapters that a download of a series selects, whether they have a file, and whether their response is one.
_SERIES = f"""t AS (SELECT doc_id, {WORK} AS work_id, doc_id % {20} + 1 AS n, n_chars, text, doc_id % 7 = 1 AS have, doc_id % 11 <> 0 AND doc_id % 9 <> 0 AS good FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY n) AS pos FROM t), sized AS (SELECT *, count(*) OVER (PARTITION BY work_id) AS total FROM p),
kept AS (SELECT * FROM sized WHERE CASE work_id % 3 WHEN 1 THEN total >= 9 AND pos BETWEEN 2 AND 9 WHEN 2 THEN total >= 5 AND pos = 5 ELSE true END)"""
ORACLE_SQL["series_totals"] = f"""WITH {_SERIES} SELECT work_id, count(*) AS n_tasks, count(*) FILTER (have) AS n_skipped, count(*) FILTER (NOT have AND good) AS n_done, count(*) FILTER (NOT have AND NOT good) AS n_failed,
CAST(coalesce(sum(length(text)) FILTER (NOT have AND good), 0) AS BIGINT) AS n_words FROM kept GROUP BY work_id"""
ORACLE_SQL["series_chapters"] = f"WITH {_SERIES} SELECT work_id, lpad(CAST(pos AS VARCHAR), 3, '0') || ' t' || doc_id || '.txt' AS file_name, md5(text) AS content_md5 FROM kept WHERE NOT have AND good"
ORACLE_SQL["series_pages"] = f"""WITH {_SERIES}, s AS (SELECT work_id, count(*) AS n, sum(n_chars) AS words, work_id % 5 = 4 AS bad FROM p GROUP BY work_id)
SELECT work_id, '系列ID: ' || work_id || {LF} || '系列名称: ' || CASE WHEN bad THEN '未知系列' ELSE 'S' || work_id END || {LF} || '作者: ' || CASE WHEN bad THEN '未知作者' ELSE 'A' END || {LF} || '更新时间: ' || CASE WHEN bad THEN '未知时间' ELSE '2020-01-02' END || {LF} || '总字数: ' || words || {LF} || '章节数: ' || n || {LF} || '标签: 无' || {LF} || {LF} || '简介:' || {LF} || CASE WHEN bad THEN '（暂无简介）' ELSE 'd' END AS text FROM s"""
_BIG = "(c_custkey % 4 > 1)"  # a style file with sections
ORACLE_SQL["style_sheets"] = f"""SELECT c_custkey, md5('h1 {{ text-align: ' || CASE WHEN c_custkey % 4 = 1 THEN 'left' ELSE 'center' END || '; font-size: ' || CASE WHEN c_custkey % 5 <> 1 AND {_BIG} THEN {_SIZED} ELSE '1.5em' END || '; text-decoration: ' || CASE WHEN c_custkey % 5 = 1 THEN 'underline' ELSE 'none' END || ';' ||
CASE WHEN c_custkey % 5 = 0 THEN ' color: #12ab;' ELSE '' END || ' }}' || {LF} || '.vol h1 {{ color: #8B0000; font-size: 2.5em; margin-top: 0.6em; }}' || {LF} || 'p {{ text-indent: 2em; margin: 0.5em 0; }}' || {LF} || '.book-info-page .book-info-name {{ font-size: 1.4em; font-weight: bold; }}' || {LF} ||
'.illustration {{ text-align: center; }}' || {LF} || '.illustration img {{ max-width: 100%; }}' || {LF} || CASE WHEN {_BIG} AND c_custkey % 2 = 0 THEN '.chapter-num {{ display: block; font-size: 1em; }}' || {LF} || '.chapter-name {{ display: block; }}' || {LF} ELSE '' END ||
CASE WHEN {_BIG} THEN '' ELSE '.vol .volume-num {{ display: block; color: #555555; font-size: 1.2em; margin-bottom: 0.6em; }}' || {LF} || '.vol .volume-name {{ display: block; color: #8B0000; font-size: 2.5em; }}' || {LF} || '.vol h1 {{ font-size: 1em; }}' || {LF} END) AS css_md5 FROM customer"""
