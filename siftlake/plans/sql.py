"""Pieces of SQL that the twins share. Written for DuckDB, whose expressions know no look-around."""

from siftlake.functions.text import DEFINITION_KEYWORDS, SQL_DEFINITIONS, STOPWORDS, TEST_FILES
from siftlake.operators.index import K1, B
from siftlake.operators.profile import DIMS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def split(tok: str) -> str:
    """The identifier and its parts."""
    camel = rf"list_transform(regexp_extract_all(regexp_replace({tok}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
    parts = f"CASE WHEN contains({tok}, '_') THEN list_filter(string_split(lower({tok}), '_'), lambda p: p <> '') ELSE {camel} END"
    return f"(CASE WHEN len({parts}) >= 2 THEN list_prepend(lower({tok}), {parts}) ELSE [lower({tok})] END)"


CHUNKS = r"""
placed AS (SELECT DISTINCT chunk_id, replace(coalesce(file_path, ''), '\', '/') AS file_path, start_line, end_line, language, coalesce(content, '') AS content
           FROM chunks WHERE chunk_id IS NOT NULL),
named AS (SELECT *, regexp_replace(string_split(file_path, '/')[-1], '(.)\.[^.]+$', '\1') AS st,
          list_filter(string_split(file_path, '/')[1:len(string_split(file_path, '/')) - 1], lambda p: p <> '' AND p <> '.') AS dirs FROM placed),
one AS (SELECT *, content || ' ' || st || ' ' || st || ' ' || array_to_string(dirs[greatest(len(dirs) - 2, 1):], ' ') AS enriched FROM named)"""

TERMS = (
    CHUNKS
    + f""",
words AS (SELECT chunk_id, unnest(regexp_extract_all(enriched, '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM one),
tfs AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({split("w")}) AS term FROM words) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
lens AS (SELECT one.chunk_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS dl FROM one LEFT JOIN tfs USING (chunk_id) GROUP BY one.chunk_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)"""
)

POSTINGS = (
    TERMS
    + f""",
posts AS (SELECT term, chunk_id, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / ({K1} * ({1 - B} + {B} * dl / avgdl) + tf) AS impact
          FROM tfs JOIN dfs USING (term) JOIN lens USING (chunk_id), corpus)"""
)

QUERIES = "asked AS (SELECT DISTINCT task_id AS query_id, query FROM tasks WHERE trim(coalesce(query, '')) <> '')"

QTERMS = f"""
qwords AS (SELECT query_id, unnest(regexp_extract_all(query, '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM asked),
qtfs AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({split("w")}) AS term FROM qwords) GROUP BY ALL)"""


def lexical(k: int, filtered: str = "TRUE") -> str:
    return f"""
bm AS (SELECT query_id, chunk_id, sum(qtfs.tf * impact) AS score FROM qtfs JOIN posts USING (term) WHERE {filtered} GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0) WHERE rank <= {k})"""


def _encoded(name: str, key: str, source: str) -> str:
    direction = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT)"
    return f"""
{name}_cells AS (SELECT {key}, {direction} % {DIMS} AS dim, sum((CASE WHEN ({direction} // {DIMS}) % 2 = 0 THEN 1.0 ELSE -1.0 END) * ln(1.0 + tf)) AS x FROM {source} GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}_cells GROUP BY ALL HAVING sqrt(sum(x * x)) > 1e-9),
{name} AS (SELECT {key}, dim, x / norm AS x FROM {name}_cells JOIN {name}_norm USING ({key}))"""


ENCODED = _encoded("cv", "chunk_id", "tfs") + "," + _encoded("qv", "query_id", "qtfs")


def semantic(k: int, filtered: str = "TRUE") -> str:
    return f"""
sims AS (SELECT q.query_id, c.chunk_id, coalesce(sum(qv.x * cv.x), 0.0) AS score
         FROM (SELECT DISTINCT query_id FROM qv) q CROSS JOIN (SELECT DISTINCT chunk_id FROM cv WHERE {filtered}) c
         LEFT JOIN qv ON qv.query_id = q.query_id LEFT JOIN cv ON cv.chunk_id = c.chunk_id AND cv.dim = qv.dim GROUP BY ALL),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sims) WHERE rank <= {k})"""


SYMBOL = (
    r"regexp_matches(trim(query), '^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+"
    r"|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$')"
)
LEAF = r"""CASE WHEN contains(query, '::') THEN string_split(query, '::')[-1] WHEN contains(query, '\') THEN string_split(query, '\')[-1]
 WHEN contains(query, '->') THEN string_split(query, '->')[-1] WHEN contains(query, '.') THEN string_split(query, '.')[-1] ELSE trim(query) END"""
EMBEDDED = r"list_distinct(regexp_extract_all(query, '\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b'))"
KEYWORDS = f"list_filter(list_distinct(list_transform(regexp_extract_all(query, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: lower(w))), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))"

FACTS = f"""
facts AS (SELECT query_id, {SYMBOL} AS symbol, CASE WHEN {SYMBOL} THEN list_distinct([{LEAF}, trim(query)]) ELSE {EMBEDDED} END AS names,
          {LEAF} AS leaf, {KEYWORDS} AS keywords, CASE WHEN {SYMBOL} THEN 0.3 ELSE 0.5 END AS alpha FROM asked)"""


def penalty(path: str) -> str:
    name = f"string_split({path}, '/')[-1]"
    test_file = "(?:^|/)(?:" + "|".join(TEST_FILES) + ")$"
    return (
        f"(CASE WHEN regexp_matches({path}, '{test_file}') OR regexp_matches({path}, '(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)') THEN 0.3 ELSE 1.0 END"
        f" * CASE WHEN {name} IN ('__init__.py', 'package-info.java') THEN 0.5 ELSE 1.0 END"
        f" * CASE WHEN regexp_matches({path}, '(?:^|/)(?:compat|_compat|legacy)(?:/|$)') THEN 0.3 ELSE 1.0 END"
        f" * CASE WHEN regexp_matches({path}, '(?:^|/)(?:_?examples?|docs?_src)(?:/|$)') THEN 0.3 ELSE 1.0 END"
        f" * CASE WHEN regexp_matches({path}, '\\.d\\.ts$') THEN 0.7 ELSE 1.0 END)::DOUBLE"
    )


def defines(content: str, name: str) -> str:
    words, sql = "|".join(DEFINITION_KEYWORDS), "|".join(SQL_DEFINITIONS)
    tail = f"'[ \\t\\n\\r\\f\\v]+(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*' || regexp_replace({name}, '([^A-Za-z0-9_])', '\\\\\\1', 'g') || '(?:\\s|[<({{:\\[;]|$)'"
    return (
        f"(regexp_matches({content}, '(?m)(?:^|\\s)(?:{words})' || {tail}) OR regexp_matches({content}, '(?mi)(?:^|\\s)(?:{sql})' || {tail}))"
    )


BARE = "replace(lower(st), '_', '')"
FORMS = f"[lower(st), {BARE}, rtrim(lower(st), 's'), rtrim({BARE}, 's')]"
PATH_TERMS = f"list_distinct(CASE WHEN len(dirs) > 0 AND dirs[-1] <> '..' THEN list_concat({split('st')}, {split('dirs[-1]')}) ELSE {split('st')} END)"
FUSED = """
fused AS (SELECT query_id, chunk_id, alpha * coalesce(1.0 / (60 + sem.rank), 0) + (1 - alpha) * coalesce(1.0 / (60 + lex.rank), 0) AS score
          FROM sem FULL JOIN lex USING (query_id, chunk_id) JOIN facts USING (query_id)),
cand AS (SELECT * FROM fused JOIN one USING (chunk_id) WHERE score <> 0)"""
COHERENT = """
summed AS (SELECT *, sum(score) OVER (PARTITION BY query_id, file_path) AS fs, max(score) OVER (PARTITION BY query_id) AS m,
           row_number() OVER (PARTITION BY query_id, file_path ORDER BY round(score, 9) DESC, start_line, chunk_id) AS fr FROM cand),
coherent0 AS (SELECT * EXCLUDE (score), score + CASE WHEN fr = 1 AND m > 0 THEN m * 0.2 * fs / max(fs) OVER (PARTITION BY query_id) ELSE 0 END AS score FROM summed),
coherent AS (SELECT * EXCLUDE (fs, m, fr), max(score) OVER (PARTITION BY query_id) AS top FROM coherent0)"""
_HIT = "k = p OR (least(length(k), length(p)) >= 3 AND (starts_with(k, p) OR starts_with(p, k)))"
PATHED = f"""
pathed AS (SELECT c.* EXCLUDE (score), c.score + CASE WHEN NOT symbol AND len(keywords) > 0
             AND len(list_filter(keywords, lambda k: len(list_filter({PATH_TERMS}, lambda p: {_HIT})) > 0)) / len(keywords) >= 0.1
             THEN top * len(list_filter(keywords, lambda k: len(list_filter({PATH_TERMS}, lambda p: {_HIT})) > 0)) / len(keywords) ELSE 0 END AS score
           FROM coherent c JOIN facts USING (query_id))"""
_SET = f"(list_contains({FORMS}, nl))"
BOOSTED = f"""
names AS (SELECT query_id, symbol, leaf, unnest(names) AS name FROM facts),
defs AS (SELECT DISTINCT n.query_id, one.chunk_id FROM names n JOIN one ON contains(lower(content), lower(name)) AND {defines("content", "name")}),
namedlike AS (SELECT DISTINCT n.query_id, one.chunk_id FROM names n JOIN one ON list_contains({FORMS}, lower(name))),
tiers AS (SELECT d.query_id, d.chunk_id, 3.0 * CASE WHEN symbol THEN 1.0 ELSE 0.5 END * CASE WHEN l.chunk_id IS NOT NULL THEN 1.5 ELSE 1.0 END AS tier
          FROM defs d JOIN facts USING (query_id) LEFT JOIN namedlike l ON l.query_id = d.query_id AND l.chunk_id = d.chunk_id),
eligible AS (SELECT DISTINCT n.query_id, one.chunk_id FROM names n JOIN one ON CASE WHEN symbol THEN list_contains({FORMS}, lower(leaf))
             ELSE lower(st) = lower(name) OR {BARE} = lower(name) OR (length(st) >= 4 AND starts_with(lower(name), lower(st))) OR (length({BARE}) >= 4 AND starts_with(lower(name), {BARE})) END),
inside AS (SELECT p.* EXCLUDE (score), p.score + coalesce(tier, 0) * top AS score FROM pathed p LEFT JOIN tiers t ON t.query_id = p.query_id AND t.chunk_id = p.chunk_id),
outside AS (SELECT t.query_id, t.chunk_id, tier * m.top AS score FROM tiers t JOIN eligible e ON e.query_id = t.query_id AND e.chunk_id = t.chunk_id
            JOIN (SELECT query_id, max(top) AS top FROM coherent GROUP BY query_id) m ON m.query_id = t.query_id
            WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id = t.query_id AND c.chunk_id = t.chunk_id)),
boosted AS (SELECT query_id, chunk_id, score FROM inside UNION ALL SELECT query_id, chunk_id, score FROM outside)"""


def ranked(k: int) -> str:
    return f"""
penal AS (SELECT b.query_id, b.chunk_id, file_path, start_line, end_line, b.score * {penalty("file_path")} AS score FROM boosted b JOIN one USING (chunk_id)),
decayed AS (SELECT * EXCLUDE (score), score * pow(0.5, row_number() OVER (PARTITION BY query_id, file_path ORDER BY round(score, 9) DESC, start_line, chunk_id) - 1) AS score FROM penal),
final AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, start_line, file_path, chunk_id) AS INTEGER) AS rank FROM decayed) WHERE rank <= {k})"""


def hybrid(k: int) -> str:
    return ",".join([POSTINGS, QUERIES, QTERMS, lexical(5 * k), ENCODED, semantic(5 * k), FACTS, FUSED, COHERENT, PATHED, BOOSTED, ranked(k)])


def modes(k: int) -> str:
    """``judged``: the first results of every query in each of eight modes; a query's number times 8 plus the mode's."""
    asked = "asked AS (SELECT DISTINCT task_id * 8 + m AS query_id, query FROM tasks, range(8) AS ms(m) WHERE trim(coalesce(query, '')) <> '')"
    alpha = "CASE query_id % 8 // 2 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN CASE WHEN symbol THEN 0.3 ELSE 0.5 END ELSE 0.5 END"
    facts = FACTS.replace("facts AS (", "facts0 AS (") + f", facts AS (SELECT * EXCLUDE (alpha), {alpha} AS alpha FROM facts0)"
    final = ranked(k).replace(penalty("file_path"), f"CASE WHEN b.query_id % 8 // 2 = 1 THEN 1.0 ELSE {penalty('file_path')} END")
    return ",".join([POSTINGS, asked, QTERMS, lexical(5 * k), ENCODED, semantic(5 * k), facts, FUSED, COHERENT, PATHED, BOOSTED, final]) + f""",
plain AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, start_line, file_path, chunk_id) AS rank FROM cand) WHERE rank <= {k}),
judged AS (SELECT query_id, chunk_id, rank FROM final WHERE query_id % 2 = 1 UNION ALL SELECT query_id, chunk_id, rank FROM plain WHERE query_id % 2 = 0)"""
