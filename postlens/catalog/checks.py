"""Pieces of check SQL for DuckDB, written apart from the Spark expressions they check."""

from __future__ import annotations

from postlens.catalog.inputs import DOCUMENT_SQL, PROSE_TERMS, RESUME_SQL, ROLE_SQL
from postlens.taxonomy import ROLE_SKILLS, Taxonomy

W = r"[\pL\pN_]"
NOT_W = r"[^\pL\pN_]"

# RE2 has no lookahead, so the patterns that use one are restated.
RESTATED = {
    r"\br\b(?=.*(stat|programming|language))":
        rf"regexp_matches(lt, '(^|{NOT_W})r[^\pL\pN_\n].*(stat|programming|language)')",
    "java(?!script)":
        "(length(lt) - length(replace(lt, 'java', ''))) / 4 > "
        "(length(lt) - length(replace(lt, 'javascript', ''))) / 10",
    r"\bcv\b(?=.*(image|vision))":
        rf"regexp_matches(lt, '(^|{NOT_W})cv[^\pL\pN_\n].*(image|vision)')",
    r"\bagents?\b(?=.*(ai|llm|autonomous))":
        rf"regexp_matches(lt, '(^|{NOT_W})agents?[^\pL\pN_\n].*(ai|llm|autonomous)')",
    r"\bllama\b(?!index)": rf"regexp_matches(lt, '(^|{NOT_W})llama({NOT_W}|$)')",
    r"\bexcel\b(?!lent|s\b)": rf"regexp_matches(lt, '(^|{NOT_W})excel({NOT_W}|$)')",
    r"\btion(?=.*(ing|ment))": rf"regexp_matches(lt, '(^|{NOT_W})tion.*(ing|ment)')",
}


def pattern_sql(pattern: str) -> str:
    """Condition on the lower-cased column `lt`."""
    if pattern in RESTATED:
        return RESTATED[pattern]
    core = pattern.removeprefix(r"\b").removesuffix(r"\b").replace("\\", "")
    if r"\b" not in pattern:
        return f"contains(lt, '{core}')"
    head = f"(^|{NOT_W})" if pattern.startswith(r"\b") else ""
    tail = f"({NOT_W}|$)" if pattern.endswith(r"\b") else ""
    return f"regexp_matches(lt, '{head}{core}{tail}')"


def tags_sql(taxonomy: Taxonomy) -> str:
    """List of the skills found in `lt`, in name order."""
    flat = {s: ps for skills in taxonomy.values() for s, ps in skills.items()}
    cases = ", ".join(
        f"CASE WHEN {' OR '.join(f'({pattern_sql(p)})' for p in flat[s])} THEN '{s}' END"
        for s in sorted(flat))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def categories_sql(taxonomy: Taxonomy) -> str:
    rows = ", ".join(f"('{s}', '{c}')" for c, skills in taxonomy.items() for s in skills)
    return f"(VALUES {rows}) AS cats(skill, category)"


SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}" \
    r"\x{202f}\x{205f}\x{3000}]"


def clean_sql(c: str) -> str:
    """Cleaning for text whose entities are among the few the given tables hold."""
    for fancy, plain in (("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"),
                         ("…", "...")):
        c = f"replace({c}, '{fancy}', '{plain}')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def truncated_sql(c: str) -> str:
    body = f"regexp_replace({c}, '{SPACE}+$', '')"
    return (f"(coalesce({c}, '') <> '' AND ({body} LIKE '%…' OR {body} LIKE '%...' OR "
            f"(length({c}) > 400 AND {body} <> '' AND right({body}, 1) NOT IN "
            "('.', '!', '?', '\"'))))")


def lcp_sql(lo: str, hi: str) -> str:
    """Length of the common prefix: how many leading cuts of both strings agree."""
    return (f"len(list_filter(range(1, least(length({lo}), length({hi})) + 1), "
            f"lambda i: substr({lo}, 1, i) = substr({hi}, 1, i)))")


def prefixes_sql(rows: str, text: str = "description_clean") -> str:
    """(company, n, prefix) over `rows`, the prefix already cut back."""
    return f"""
      SELECT company, n, CASE WHEN contains(p, ' ')
          THEN left(p, length(p) - strpos(reverse(p), ' ')) ELSE p END AS prefix
      FROM (SELECT company, n, left(lo, {lcp_sql("lo", "hi")}) AS p
            FROM (SELECT company, count(*) AS n, min({text}) AS lo, max({text}) AS hi FROM {rows}
                  WHERE coalesce(company, '') <> '' GROUP BY company) WHERE n >= 2)
      WHERE length(p) >= 60"""


# First match of each pattern in turn; the digits are then read from the phrase.
BAND_PHRASE = """coalesce(
  nullif(regexp_extract(lt, '\\d+\\s*-\\s*\\d+\\s*\\+?\\s*years?'), ''),
  nullif(regexp_extract(lt, '\\d+\\s*to\\s*\\d+\\s*years?'), ''),
  nullif(regexp_extract(lt, '\\d+\\s*\\+\\s*years?'), ''),
  nullif(regexp_extract(lt, 'minimum\\s*(?:of\\s*)?\\d+\\s*years?'), ''))"""

# Raw role postings, cleaned row by row.
ROLE_CLEAN = f"""raw AS ({ROLE_SQL}),
cleaned AS (
  SELECT source, query AS search_query, job_id, coalesce(title, '') AS title, company, location,
    {clean_sql("description_snippet")} AS description_clean,
    {truncated_sql("description_snippet")} AS description_is_truncated, posted_date, url
  FROM raw)"""


def tagged_sql(rows: str, taxonomy: Taxonomy = ROLE_SKILLS) -> str:
    """`rows` with skills and band."""
    return f"""
  SELECT * EXCLUDE (lt, phrase), len(skills_extracted) AS skill_count,
    try_cast(regexp_extract_all(phrase, '\\d+')[1] AS INTEGER) AS exp_min_years,
    try_cast(regexp_extract_all(phrase, '\\d+')[2] AS INTEGER) AS exp_max_years
  FROM (SELECT *, {tags_sql(taxonomy)} AS skills_extracted, {BAND_PHRASE} AS phrase
        FROM (SELECT *, lower(title || ' ' || description_clean) AS lt FROM {rows}))"""


# Row-local form: cleaned and tagged, neither stripped nor merged.
ROLE_TAGGED = f"WITH {ROLE_CLEAN}, t AS ({tagged_sql('cleaned')})"

# The whole clean table.
ROLE_TABLE = f"""WITH {ROLE_CLEAN},
prefixes AS ({prefixes_sql("cleaned")}),
stripped AS (
  SELECT c.* REPLACE (CASE WHEN p.prefix IS NULL THEN c.description_clean
    ELSE trim(substr(c.description_clean, length(p.prefix) + 1)) END AS description_clean)
  FROM cleaned c LEFT JOIN prefixes p ON c.company = p.company),
merged AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY company, title ORDER BY length(description_clean)
      DESC, job_id, url, source, description_clean) AS rn FROM stripped) WHERE rn = 1),
t AS ({tagged_sql("merged")})"""

DOCUMENT_TAGGED = f"""WITH t AS (
  SELECT * EXCLUDE (lt), len(skills_extracted) AS skill_count
  FROM (SELECT *, {tags_sql(PROSE_TERMS)} AS skills_extracted
        FROM (SELECT *, lower(title || ' ' || description_clean) AS lt FROM ({DOCUMENT_SQL}))))"""

RESUME_TAGGED = f"""r AS (
  SELECT * EXCLUDE (lt) FROM (SELECT *, {tags_sql(PROSE_TERMS)} AS skills_extracted
    FROM (SELECT *, lower(text) AS lt FROM ({RESUME_SQL}))))"""


# What a pattern with more than a word and its edges asks for: words, edges, one of these later in the
# line, not this next.
SHAPES = {
    r"\br\b(?=.*(stat|programming|language))": (["r"], True, True, "stat|programming|language", None),
    "java(?!script)": (["java"], False, False, None, "script"),
    r"\bcv\b(?=.*(image|vision))": (["cv"], True, True, "image|vision", None),
    r"\bagents?\b(?=.*(ai|llm|autonomous))": (["agents", "agent"], True, True, "ai|llm|autonomous", None),
    r"\bllama\b(?!index)": (["llama"], True, True, None, None),
    r"\bexcel\b(?!lent|s\b)": (["excel"], True, True, None, None),
}


def shapes_sql(taxonomy: Taxonomy) -> str:
    """(skill, place, w, opens, closes, later, never): every pattern as a word to look for, in order."""
    rows = []
    for patterns in (ps for skills in taxonomy.values() for ps in skills.items()):
        place = 0
        for pattern in patterns[1]:
            core = pattern.removeprefix(r"\b").removesuffix(r"\b").replace("\\", "")
            plain = ([core], pattern.startswith(r"\b"), pattern.endswith(r"\b"), None, None)
            words, opens, closes, later, never = SHAPES.get(pattern, plain)
            for w in words:
                values = [f"'{patterns[0]}'", str(place), f"'{w}'", str(opens), str(closes),
                          f"'{later}'" if later else "NULL", f"'{never}'" if never else "NULL"]
                rows.append("(" + ", ".join(values) + ")")
                place += 1
    return f"(VALUES {', '.join(rows)}) AS v(skill, place, w, opens, closes, later, never)"


def spans_sql(rows: str, text: str, taxonomy: Taxonomy, around: int = 30) -> str:
    """(skill, span, hits): words are found by splitting, their surroundings by position, and of hits
    that overlap the first stays."""
    return f"""p AS (SELECT * FROM {shapes_sql(taxonomy)}),
  d AS (SELECT row_number() OVER () AS id, lower({text}) AS d FROM {rows}),
  s AS (SELECT id, d, p.*, string_split(d, w) AS parts FROM d JOIN p ON contains(d, w)),
  h AS (SELECT * EXCLUDE (parts), CAST(list_sum(list_transform(parts[1:i], lambda x: length(x)))
      + (i - 1) * length(w) AS BIGINT) AS b, b + length(w) AS e FROM s, unnest(range(1, len(parts))) AS t(i)),
  k AS (SELECT id, d, skill, list([{{'b': b, 'e': e}}] ORDER BY b, place) AS hits FROM h
    WHERE (NOT opens OR b = 0 OR NOT regexp_matches(d[b], '[\\pL\\pN_]'))
      AND (NOT closes OR e = length(d) OR NOT regexp_matches(d[e + 1], '[\\pL\\pN_]'))
      AND (later IS NULL OR len(list_filter(string_split(later, '|'),
        lambda x: contains(string_split(d[e + 1:], chr(10))[1], x))) > 0)
      AND (never IS NULL OR NOT starts_with(d[e + 1:], never))
    GROUP BY id, d, skill),
  c AS (SELECT d, skill, unnest(list_reduce(hits, lambda a, x: CASE WHEN x[1].b >= a[-1].e
    THEN list_concat(a, x) ELSE a END)) AS hit FROM k),
  x AS (SELECT skill, string_split(d[greatest(hit.b - {around}, 0) + 1:hit.b], chr(10))[-1]
    || d[hit.b + 1:hit.e] || string_split(d[hit.e + 1:hit.e + {around}], chr(10))[1] AS span FROM c)"""
