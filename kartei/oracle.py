"""The queries of kartei.queries again, as SQL for DuckDB over the same tables.

Written from the operators' definitions and independent of their plans: no sampling of folders is needed below 2000 files.
"""

from __future__ import annotations

from kartei import planted
from kartei.functions import kinds, text as T, tokens as K
from kartei.queries import LIMITS, MARKERS, RULES
from kartei.settings import FAMILIES, IGNORED_FOLDERS, OTHER_WEIGHT, WEIGHTS
from kartei.sources.ignore import NOTABLE_HIDDEN, compile_rule


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(s: str) -> str:
    spaced = f"regexp_replace(regexp_replace({s}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z]{{2,}})', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({spaced}, {lit(K.SEPARATOR)}), lambda w: lower(w)), lambda w: w <> '')"


def bare(w: str) -> str:
    found = f"regexp_extract({w}, {lit(K.VERSIONED)}, 1)"
    return f"CASE WHEN {found} IN ({quoted(K.REVISION)}) THEN {found} ELSE {w} END"


def bare_words(s: str) -> str:
    return f"list_transform({words(s)}, lambda w: {bare('w')})"


def like(w: str, pattern: str) -> str:
    return f"regexp_matches({w}, {lit(pattern)})"


def name_words(s: str, noise: bool = True) -> str:
    keep = f"length(w) >= 2 AND NOT {like('w', K.DIGITS)} AND NOT {like('w', K.HEX)} AND NOT {like('w', K.NUMBERED)} AND w NOT IN ({quoted(K.MONTHS)})"
    return f"list_filter({bare_words(s)}, lambda w: {keep}{f' AND w NOT IN ({quoted(K.NOISE)})' if noise else ''})"


def content_words(s: str, limit: int = 200) -> str:
    return f"list_filter({words(s)}, lambda w: length(w) >= 3 AND NOT {like('w', K.DIGITS)} AND w NOT IN ({quoted(K.NOISE)}))[1:{limit}]"


def base(s: str) -> str:
    return f"array_to_string(list_filter({bare_words(s)}, lambda w: w NOT IN ({quoted(K.NOISE)}) AND NOT {like('w', K.DIGITS)} AND NOT {like('w', K.NUMBERED)}), ' ')"


def markers(s: str) -> str:
    marked = f"list_filter({words(s)}, lambda w: {bare('w')} IN ({quoted(K.REVISION)}))"
    suffix = f"(len(list_filter({words(s)}, lambda w: {like('w', K.NUMBERED)})) > 0 OR {like(s, K.COPY_NUMBER)})"
    return f"list_concat({marked}, CASE WHEN {suffix} THEN ['version-suffix'] ELSE [] END)"


def ramp(v: str, low: float, high: float) -> str:
    if high <= low:
        return f"(CASE WHEN {v} >= {high} THEN 1.0 ELSE 0.0 END)::DOUBLE"
    return f"greatest(0.0, least(1.0, ({v} - {low}) / ({high} - {low})::DOUBLE))"


def clean(s: str) -> str:
    spaced = f"regexp_replace(regexp_replace({s}, {lit(T.INLINE)}, ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g')"
    return f"substring(regexp_replace(regexp_replace({spaced}, ' ?\\n ?', E'\\n', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g'), 1, 1000)"


LATEST = """
latest AS (SELECT file_id, folder, path, name, stem, lower(coalesce(ext, '')) AS ext, size, mtime FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC, ingested_at DESC, coalesce(size, -1) DESC,
    coalesce(epoch_us(mtime), 0) DESC, coalesce(ext, '') DESC, coalesce(kind, '') DESC) AS turn FROM files WHERE file_id IS NOT NULL) WHERE turn = 1)"""
KINDS = f"""
ext_kinds(ext, kind) AS (VALUES {", ".join(f"('{e}', '{k}')" for e, k in sorted(kinds.KIND_OF.items()))}),
kind_facts(kind, domain, textual, phrase) AS (VALUES {", ".join(f"('{k}', '{d}', {str(k in kinds.TEXTUAL).lower()}, '{kinds.PHRASES[k]}')" for k, d in sorted(kinds.DOMAIN_OF.items()))}),
named AS (SELECT l.*, CASE WHEN regexp_matches(name, {lit(kinds.LEFTOVER)}) THEN 'junk' ELSE coalesce(e.kind, 'unknown') END AS kind
  FROM latest l LEFT JOIN ext_kinds e ON regexp_replace(l.ext, '^\\.+', '') = e.ext),
kinded AS (SELECT n.*, f.domain, f.textual, f.phrase FROM named n JOIN kind_facts f USING (kind))"""
TEXTS = """
texts AS (SELECT file_id, max(text) AS text FROM extracted WHERE file_id IS NOT NULL AND text IS NOT NULL GROUP BY file_id)"""
WRITTEN = """
written AS (SELECT k.*, coalesce(t.text, '') AS text FROM kinded k LEFT JOIN texts t USING (file_id))"""
TREE = """
names AS (SELECT DISTINCT folder FROM folders WHERE folder IS NOT NULL),
tree AS (SELECT a.folder AS ancestor, d.folder AS descendant, (len(string_split(d.folder, '/')) - len(string_split(a.folder, '/')))::INT AS distance
  FROM names a, names d WHERE a.folder = d.folder OR starts_with(d.folder, a.folder || '/'))"""
UNITS = """
usable AS (SELECT folder, file_id, max(vec)::DOUBLE[] AS vec, max(coalesce(topical, false)) AS topical FROM vectors
  WHERE folder IS NOT NULL AND file_id IS NOT NULL AND len(vec) = 128 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
  GROUP BY folder, file_id),
units AS (SELECT u.folder, u.file_id, u.topical, list_transform(u.vec, lambda x: x / sqrt(list_inner_product(u.vec, u.vec))) AS vec FROM usable u)"""
MEMBERS = """
members AS (SELECT folder, file_id, max(cluster) AS cluster FROM clusters WHERE folder IS NOT NULL AND file_id IS NOT NULL GROUP BY folder, file_id),
sizes AS (SELECT folder, cluster, count(*) AS size FROM members WHERE cluster >= 0 GROUP BY folder, cluster),
main AS (SELECT s.* FROM sizes s JOIN (SELECT folder, count(*) AS n FROM members GROUP BY folder) USING (folder) WHERE size >= greatest(3, floor(0.10 * n)))"""
MEANS = """
held AS (SELECT u.folder, m.cluster, u.vec FROM units u JOIN members m USING (folder, file_id) WHERE cluster >= 0),
mean_parts AS (SELECT folder, cluster, i, avg(x) AS x FROM (SELECT folder, cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM held) GROUP BY folder, cluster, i),
means AS (SELECT folder, cluster, list(x ORDER BY i) AS mean FROM mean_parts GROUP BY folder, cluster)"""
SUBJECTS = """
chief AS (SELECT folder, cluster FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY size DESC, cluster) AS turn FROM main) WHERE turn = 1),
subjects AS (SELECT folder, list_transform(mean, lambda x: CASE WHEN sqrt(list_inner_product(mean, mean)) > 1e-8 THEN x / sqrt(list_inner_product(mean, mean)) ELSE 0 END) AS subject
  FROM means JOIN chief USING (folder, cluster))"""
DATED = """
dated AS (SELECT *, coalesce(epoch_us(mtime) / 1e6, 0) AS t FROM latest WHERE folder IS NOT NULL),
stepped AS (SELECT folder, file_id, t, CASE WHEN t - lag(t) OVER w > 365 * 86400 THEN 1 ELSE 0 END AS step FROM dated WINDOW w AS (PARTITION BY folder ORDER BY t, file_id)),
in_eras AS (SELECT folder, file_id, t, sum(step) OVER (PARTITION BY folder ORDER BY t, file_id ROWS UNBOUNDED PRECEDING) AS era FROM stepped),
eras AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY folder, era) AS era_size FROM in_eras) WHERE era_size >= 3)"""
DOMINANT = """
met AS (SELECT folder, era, cluster, count(*) AS n, min((t, file_id)) AS first FROM eras JOIN members USING (folder, file_id) WHERE cluster >= 0 GROUP BY folder, era, cluster),
top AS (SELECT folder, era, cluster FROM (SELECT *, row_number() OVER (PARTITION BY folder, era ORDER BY n DESC, first) AS turn FROM met) WHERE turn = 1),
dominant AS (SELECT e.folder, e.era, coalesce(cluster, -1) AS dominant FROM (SELECT DISTINCT folder, era FROM eras JOIN members USING (folder, file_id)) e LEFT JOIN top USING (folder, era))"""


def marker_list(s: str) -> str:
    flags = "[" + ", ".join(f"CASE WHEN contains(lower({s}), '{m}') THEN 1.0 ELSE 0.0 END" for m in MARKERS) + "]"
    return f"list_transform({flags}, lambda x: CASE WHEN list_sum({flags}) > 0 THEN x / sqrt(list_sum({flags})) ELSE 0 END)"


def blank(s: str) -> str:
    return f"regexp_replace({s}, '[\\s\\p{{Z}}]+', '', 'g') = ''"


def exploded(rows: str, keys: str, vector: str) -> str:
    return f"SELECT {keys}, (i - 1)::INT AS i, round(x, 5) AS x FROM (SELECT {keys}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS i FROM {rows})"


PHRASES = f"""
toks AS (SELECT file_id, folder, stem, kind, textual, phrase, size, text, {name_words("stem")} AS tokens FROM written WHERE folder IS NOT NULL AND stem IS NOT NULL),
folder_n AS (SELECT folder, count(*) AS n FROM toks GROUP BY folder),
with_token AS (SELECT folder, token, count(*) AS c FROM (SELECT folder, unnest(list_distinct(tokens)) AS token FROM toks) GROUP BY folder, token),
common AS (SELECT folder, list(token) AS common FROM with_token JOIN folder_n USING (folder) WHERE n >= 5 AND c >= 0.7 * n GROUP BY folder),
phrased AS (SELECT t.*, array_to_string(list_filter(t.tokens, lambda x: NOT list_contains(coalesce(c.common, []), x)), ' ') AS name_phrase FROM toks t LEFT JOIN common c USING (folder)),
mixes AS (SELECT p.*, CASE WHEN NOT has_text AND NOT has_name THEN 0.0 WHEN has_text AND described THEN 0.85 WHEN has_text THEN 0.45 + g * 0.3 ELSE 0.0 END AS text_share,
    CASE WHEN has_text AND described THEN 0.15 WHEN has_text THEN 0.55 * 8 / 11 + g * (0.25 * 4 / 5 - 0.55 * 8 / 11) WHEN has_name THEN 0.8 ELSE 0.0 END AS name_share,
    CASE WHEN has_text AND described THEN 0.0 WHEN has_text THEN 0.55 * 3 / 11 + g * (0.25 / 5 - 0.55 * 3 / 11) WHEN has_name THEN 0.2 ELSE 1.0 END AS kind_share
  FROM (SELECT *, NOT {blank("text")} AS has_text, trim(name_phrase) <> '' AS has_name, NOT textual AND regexp_matches(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{3,}}') AS described,
      least(1.0, length(text) / 120.0) * least(1.0, length(text) / 120.0) * (3 - 2 * least(1.0, length(text) / 120.0)) AS g FROM phrased) p)"""


def scaled(s: str, share: str) -> str:
    return f"list_transform({marker_list(s)}, lambda v: v * sqrt({share}))"


FILE_TERMS = f"""
file_terms AS (SELECT file_id, folder, term, sum(n) AS n FROM (
  SELECT file_id, folder, unnest({name_words("stem")}) AS term, 2 AS n FROM written WHERE folder IS NOT NULL AND stem IS NOT NULL
  UNION ALL SELECT file_id, folder, unnest({content_words("text")}) AS term, 1 AS n FROM written WHERE folder IS NOT NULL AND stem IS NOT NULL) GROUP BY ALL)"""
DEBRIS = f"""
debris_files AS (SELECT file_id, folder, CASE WHEN regexp_matches(name, {lit(kinds.LEFTOVER)}) THEN 'leftover' WHEN size = 0 THEN 'empty'
  WHEN regexp_matches(stem, {lit(kinds.UNNAMED)}) THEN 'never named' END AS reason FROM latest)"""
FAMILIES_SQL = f"""
families AS (SELECT folder, base, ext, count(*) AS members, sum(CASE WHEN len(marks) > 0 THEN 1 ELSE 0 END) AS marked, min(file_id) AS first FROM (
  SELECT folder, ext, file_id, {base("stem")} AS base, {markers("stem")} AS marks FROM latest WHERE folder IS NOT NULL AND stem IS NOT NULL) WHERE length(base) >= 3 GROUP BY folder, base, ext),
piles AS (SELECT * FROM families WHERE members >= 3 AND marked > 0)"""
SIMPLE = f"""
counts AS (SELECT folder, count(*) AS n_files FROM latest WHERE folder IS NOT NULL AND stem IS NOT NULL GROUP BY folder),
found AS (
  SELECT folder, 'debris' AS code, greatest({ramp("c", 2, 12)}, {ramp("c / n_files", 0.05, 0.35)}) AS severity FROM
    (SELECT folder, count(*) AS c FROM debris_files JOIN latest USING (file_id, folder) WHERE reason IS NOT NULL AND stem IS NOT NULL GROUP BY folder) JOIN counts USING (folder) WHERE c >= 2
  UNION ALL SELECT folder, 'version_pileups', 0.9 * greatest({ramp("p", 1, 5)}, {ramp("m / n_files", 0.05, 0.4)}) FROM
    (SELECT folder, count(*) AS p, sum(members) AS m FROM piles GROUP BY folder) JOIN counts USING (folder)
  UNION ALL SELECT folder, 'overcrowded', {ramp("n_files", 40, 240)} FROM counts WHERE n_files > 40),
strongest AS (SELECT folder, family, max(c) AS c FROM (SELECT folder, CASE {" ".join(f"WHEN code = '{c}' THEN '{f}'" for c, f in FAMILIES.items())} ELSE code END AS family,
  least(0.999, severity * CASE {" ".join(f"WHEN code = '{c}' THEN {w}" for c, w in WEIGHTS.items())} ELSE {OTHER_WEIGHT} END) AS c FROM found) GROUP BY folder, family),
scored AS (SELECT folder, 100 * (1 - exp(sum(ln(1 - c)))) AS score FROM strongest GROUP BY folder),
judged AS (SELECT folder, n_files::INT AS n_files, n_files >= 6 AS judged, CASE WHEN n_files >= 6 THEN round(coalesce(score, 0), 6) ELSE 0 END AS score FROM counts LEFT JOIN scored USING (folder)),
verdicts AS (SELECT *, (CASE WHEN score >= 75 THEN 3 WHEN score >= 50 THEN 2 WHEN score >= 25 THEN 1 ELSE 0 END)::INT AS verdict FROM judged)"""
LABELS = "CASE verdict WHEN 0 THEN 'tidy' WHEN 1 THEN 'lived-in' WHEN 2 THEN 'messy' ELSE 'chaotic' END"


def select(body: str, *parts: str) -> str:
    return f"WITH RECURSIVE {','.join(parts)} {body}"


def values(columns: str, rows) -> str:
    """Expected rows as they are."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else lit(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


MAIN = """
file_counts AS (SELECT folder, count(*) AS n_files FROM latest WHERE folder IS NOT NULL AND stem IS NOT NULL AND name IS NOT NULL GROUP BY folder),
chief_clusters AS (SELECT s.folder, s.cluster, s.size FROM sizes s JOIN file_counts USING (folder) WHERE size >= greatest(3, floor(0.10 * n_files)))"""
RELATED = f"""
alike AS (SELECT x.folder, x.cluster AS a, y.cluster AS b, list_inner_product(x.mean, y.mean) AS similarity FROM means x JOIN means y ON x.folder = y.folder AND x.cluster < y.cluster
  JOIN chief_clusters p ON p.folder = x.folder AND p.cluster = x.cluster JOIN chief_clusters q ON q.folder = y.folder AND q.cluster = y.cluster),
name_words AS (SELECT folder, file_id, unnest({name_words("stem")}) AS t FROM latest WHERE folder IS NOT NULL AND stem IS NOT NULL),
name_sets AS (SELECT folder, cluster, list(DISTINCT t) AS t FROM name_words JOIN members USING (folder, file_id) JOIN chief_clusters USING (folder, cluster) GROUP BY folder, cluster),
named_alike AS (SELECT x.folder, x.cluster AS a, y.cluster AS b FROM name_sets x JOIN name_sets y ON x.folder = y.folder AND x.cluster < y.cluster WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.35),
threads AS (SELECT a.folder, a.a, a.b, a.similarity, n.a IS NOT NULL AS thread FROM alike a LEFT JOIN named_alike n ON n.folder = a.folder AND n.a = a.a AND n.b = a.b)"""
GREEDY = f"""
related AS (SELECT folder, a, b FROM alike WHERE similarity >= {LIMITS.unrelated!r} UNION SELECT folder, a, b FROM named_alike),
near AS (SELECT folder, c, list(o) AS related FROM (SELECT folder, a AS c, b AS o FROM related UNION ALL SELECT folder, b, a FROM related) GROUP BY folder, c),
ordered AS (SELECT folder, cluster, size, row_number() OVER (PARTITION BY folder ORDER BY size DESC, cluster) AS k FROM chief_clusters),
walk AS (SELECT folder, k, [cluster] AS taken FROM ordered WHERE k = 1 UNION ALL
  SELECT w.folder, o.k, CASE WHEN list_has_any(w.taken, coalesce(x.related, [])) THEN w.taken ELSE list_append(w.taken, o.cluster) END
  FROM walk w JOIN ordered o ON o.folder = w.folder AND o.k = w.k + 1 LEFT JOIN near x ON x.folder = o.folder AND x.c = o.cluster)"""
CHOSEN = """
ends AS (SELECT folder, arg_max(taken, k) AS taken FROM walk GROUP BY folder),
chosen AS (SELECT c.folder, c.cluster, s.size, c.turn FROM (SELECT folder, unnest(taken) AS cluster, (generate_subscripts(taken, 1) - 1)::INT AS turn FROM ends) c JOIN chief_clusters s USING (folder, cluster))"""


def _rules() -> str:
    rules = [r for b, line in RULES if (r := compile_rule(b, line))]
    return "rules(base, pattern, folders_only) AS (VALUES " + ", ".join(f"({lit(r.base)}, {lit(r.pattern)}, {str(r.folders_only).lower()})" for r in rules) + ")"


WAYS = """
below AS (SELECT file_id, pattern, folders_only, string_split(substring(path, length(base) + 2), '/') AS parts FROM latest, rules WHERE starts_with(path, base || '/')),
ways AS (SELECT file_id, pattern, folders_only, parts, unnest(range(1, len(parts) + 1)) AS k FROM below),
ignored AS (SELECT DISTINCT file_id FROM ways WHERE (k < len(parts) OR NOT folders_only) AND regexp_matches(array_to_string(parts[1:k], '/'), pattern))"""

PAGE = "'<html><head><style>p { color: red }</style><script>var a = ''<p>'';</script></head><body><p>' || replace(replace(text, E'\\n', '</p><p>'), ',', '<br></br>&amp;&lt;b&gt;') || '</p></body></html>'"


def unmarked(s: str) -> str:
    body = f"regexp_replace(regexp_replace({s}, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace(regexp_replace({body}, {lit(T.BLANK_TAGS)}, ' ', 'g'), {lit(T.LINE_TAGS)}, E'\\n', 'g'), '<[^>]+>', '', 'g')"
    for entity, char in T.ENTITIES:
        out = f"replace({out}, '{entity}', {lit(char)})"
    return out


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


SQL: dict[str, str] = {
    "kind_dimension": select("SELECT file_id, kind, domain, textual FROM kinded", LATEST, KINDS),
    "debris_files": select("SELECT file_id, reason FROM debris_files WHERE reason IS NOT NULL", LATEST, DEBRIS),
    "unnamed_files": select(f"SELECT file_id, stem FROM latest WHERE regexp_matches(stem, {lit(kinds.UNNAMED)})", LATEST),
    "split_words": select(f"SELECT file_id, array_to_string({words('stem')}, ' ') AS words FROM latest WHERE stem IS NOT NULL", LATEST),
    "name_tokens": select(f"SELECT file_id, array_to_string({name_words('stem')}, ' ') AS words, array_to_string({name_words('stem', False)}, ' ') AS all_words FROM latest WHERE stem IS NOT NULL", LATEST),
    "content_tokens": select(f"SELECT file_id, array_to_string({content_words('text')}, ' ') AS words FROM texts", TEXTS),
    "base_stem": select(f"SELECT file_id, {base('stem')} AS base FROM latest WHERE stem IS NOT NULL", LATEST),
    "version_markers": select(f"SELECT file_id, array_to_string({markers('stem')}, ' ') AS markers FROM latest WHERE stem IS NOT NULL", LATEST),
    "version_pileups": select("SELECT folder, base, ext, members, first FROM piles", LATEST.replace("folder, path", "regexp_extract(folder, '^/[^/]+') AS folder, path", 1).replace("lower(coalesce(ext, '')) AS ext", "'' AS ext"), FAMILIES_SQL),
    "clean_text": f"SELECT doc_id, {clean('text')} AS excerpt FROM documents WHERE text IS NOT NULL",
    "html_text": f"SELECT doc_id, {clean(unmarked(PAGE))} AS excerpt FROM documents WHERE text IS NOT NULL",
    "legacy_runs": f"SELECT doc_id, {clean("array_to_string(regexp_extract_all(text, '[\\x20-\\x7e]{6,}'), ' ')")} AS excerpt FROM documents WHERE text IS NOT NULL",
    "even_sample": select(
        "SELECT p.file_id, k::BIGINT AS pos, greatest(0, n - 24)::INT AS truncated FROM placed p, kept WHERE p.folder = kept.folder AND p.place = kept.at",
        LATEST,
        KINDS,
        "placed AS (SELECT file_id, folder, row_number() OVER (PARTITION BY folder ORDER BY name, file_id) - 1 AS place, count(*) OVER (PARTITION BY folder) AS n FROM kinded WHERE kind = 'image' AND folder IS NOT NULL)",
        "kept AS (SELECT DISTINCT folder, n2.k, CASE WHEN n <= 24 THEN n2.k ELSE floor(n2.k * (n / 24.0::DOUBLE)) END AS at FROM placed, (SELECT unnest(range(24)) AS k) n2)",
    ),
    "hidden_filter": select(
        f"SELECT file_id FROM latest WHERE name IS NOT NULL AND path IS NOT NULL AND NOT (starts_with(name, '.') AND NOT regexp_matches(name, {lit(NOTABLE_HIDDEN)})) AND len(list_filter(string_split(path, '/')[1:-2], lambda p: p IN ({quoted(sorted(IGNORED_FOLDERS))}))) = 0",
        LATEST,
    ),
    "ignore_antijoin": select("SELECT file_id FROM latest WHERE path IS NOT NULL AND file_id NOT IN (SELECT file_id FROM ignored)", LATEST, _rules(), WAYS),
    "ancestry_expand": select("SELECT ancestor, descendant, distance FROM tree", TREE),
    "subtree_rollup": select(
        "SELECT ancestor AS folder, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, count(*) AS folders FROM tree JOIN own ON descendant = folder GROUP BY ancestor",
        LATEST, TREE, "own AS (SELECT folder, count(*) AS files, sum(coalesce(size, 0)) AS bytes FROM latest WHERE folder IS NOT NULL GROUP BY folder)",
    ),
    "depth_filter": select(
        "SELECT ancestor AS folder, depth, sum(files)::BIGINT AS files FROM tree JOIN own ON descendant = folder JOIN (SELECT descendant AS d, max(distance) AS depth FROM tree GROUP BY descendant) ON ancestor = d WHERE depth <= 2 GROUP BY ancestor, depth",
        LATEST, TREE, "own AS (SELECT folder, count(*) AS files FROM latest WHERE folder IS NOT NULL GROUP BY folder)",
    ),
    "nested_roots": select("SELECT folder AS root FROM names WHERE folder NOT IN (SELECT descendant FROM tree WHERE distance > 0)", TREE),
    "reported_once": select("SELECT descendant AS folder, arg_max(ancestor, distance) AS root FROM tree GROUP BY descendant", TREE),
    "exact_duplicates": select("SELECT regexp_extract(folder, '^/[^/]+') AS folder, min(file_id) AS first, count(*) AS copies FROM written WHERE folder IS NOT NULL AND text <> '' GROUP BY ALL, text HAVING count(*) > 1".replace("GROUP BY ALL, text", "GROUP BY regexp_extract(folder, '^/[^/]+'), text"), LATEST, KINDS, TEXTS, WRITTEN),
    "common_name_tokens": select("SELECT file_id, name_phrase FROM phrased", LATEST, KINDS, TEXTS, WRITTEN, PHRASES),
    "marker_vectors": select(exploded(f"(SELECT file_id, {marker_list('text')} AS v FROM texts)", "file_id", "v"), TEXTS),
    "distinct_encode": select(exploded(f"(SELECT file_id, CASE WHEN {blank('text')} THEN [0.0, 0.0, 0.0, 0.0] ELSE {marker_list('text')} END AS v FROM texts)", "file_id", "v"), TEXTS),
    "channel_mix": select("SELECT file_id, round(text_share, 6) AS text_share, round(name_share, 6) AS name_share, round(kind_share, 6) AS kind_share FROM mixes", LATEST, KINDS, TEXTS, WRITTEN, PHRASES),
    "composite_vectors": select(
        exploded("(SELECT file_id, CASE WHEN kind = 'junk' OR coalesce(size = 0, false) THEN list_transform(v, lambda x: 0.0) ELSE list_transform(v, lambda x: CASE WHEN list_inner_product(v, v) > 0 THEN x / sqrt(list_inner_product(v, v)) ELSE 0 END) END AS u FROM joined)", "file_id", "u"),
        LATEST, KINDS, TEXTS, WRITTEN, PHRASES,
        f"joined AS (SELECT file_id, kind, size, list_concat(list_concat({scaled('text', 'text_share')}, {scaled('name_phrase', 'name_share')}), {scaled('phrase', 'kind_share')})::DOUBLE[] AS v FROM mixes)",
    ),
    "term_counts": select("SELECT file_id, term, n::BIGINT AS n FROM file_terms", LATEST, KINDS, TEXTS, WRITTEN, FILE_TERMS),
    "folder_profiles": select(
        "SELECT folder, n, (i - 1)::INT AS i, round(avg(x), 5) AS x FROM (SELECT folder, n, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM units JOIN (SELECT folder, count(*) AS n FROM units GROUP BY folder) USING (folder) WHERE n >= 3) GROUP BY folder, n, i", UNITS
    ),
    "pair_similarity": select(f"SELECT * FROM (SELECT x.folder, x.file_id AS a, y.file_id AS b, round({dot('x.vec', 'y.vec')}, 5) AS similarity FROM units x JOIN units y ON x.folder = y.folder AND x.file_id < y.file_id WHERE {dot('x.vec', 'y.vec')} >= 0.9)", UNITS),
    "closest_similarity": select(f"SELECT x.folder, x.file_id, round(CASE WHEN count(y.file_id) = 0 THEN 0 ELSE least(1, greatest(-1, max({dot('x.vec', 'y.vec')}))) END, 5) AS closest FROM units x LEFT JOIN units y ON x.folder = y.folder AND x.file_id <> y.file_id GROUP BY x.folder, x.file_id", UNITS),
    "group_similarity": select(f"SELECT x.folder, x.cluster AS a, y.cluster AS b, round({dot('x.mean', 'y.mean')}, 5) AS similarity FROM means x JOIN means y ON x.folder = y.folder AND x.cluster <= y.cluster", UNITS, MEMBERS, MEANS),
    "meaningful_clusters": select("SELECT folder, cluster, size FROM main", MEMBERS),
    "dominant_subject": select(exploded("subjects", "folder", "subject"), UNITS, MEMBERS, MEANS, SUBJECTS),
    "class_tfidf_labels": select(
        "SELECT s.folder, s.cluster, coalesce(l.label, 'no shared wording') AS label FROM docs s LEFT JOIN labels l USING (folder, cluster)",
        LATEST, KINDS, TEXTS, WRITTEN, FILE_TERMS, MEMBERS,
        "docs AS (SELECT folder, cluster, size AS docs, count(*) OVER (PARTITION BY folder) AS clusters FROM sizes)",
        "grouped AS (SELECT folder, cluster, term, sum(n) AS n, count(*) AS with_term FROM file_terms JOIN members USING (folder, file_id) WHERE cluster >= 0 GROUP BY folder, cluster, term)",
        "rated AS (SELECT g.*, docs, n / (sum(n) OVER (PARTITION BY folder, cluster)) * (ln(clusters / (count(*) OVER (PARTITION BY folder, term))) + 1) * sqrt(length(term)) AS score FROM grouped g JOIN docs USING (folder, cluster))",
        "best AS (SELECT *, row_number() OVER (PARTITION BY folder, cluster ORDER BY round(score, 9) DESC, term) AS turn FROM rated WHERE with_term / docs >= 0.30 AND score >= 0.0015)",
        "labels AS (SELECT folder, cluster, string_agg(term, ' · ' ORDER BY turn) AS label FROM best WHERE turn <= 3 GROUP BY folder, cluster)",
    ),
    "leave_one_out_fit": select(
        "SELECT folder, file_id, round(list_inner_product(vec, coalesce(subject, list_transform(rest, lambda x: CASE WHEN sqrt(list_inner_product(rest, rest)) > 1e-8 THEN x / sqrt(list_inner_product(rest, rest)) ELSE 0 END))), 5) AS fit FROM rests",
        UNITS, MEMBERS, MEANS, SUBJECTS,
        "parts AS (SELECT folder, i, sum(x) AS x, count(*) AS n FROM (SELECT folder, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM units WHERE topical) GROUP BY folder, i)",
        "totals AS (SELECT folder, list(x ORDER BY i) AS total FROM parts WHERE n >= 2 GROUP BY folder)",
        "rests AS (SELECT u.folder, u.file_id, u.vec, s.subject, list_transform(list_zip(t.total, u.vec), lambda p: p[1] - p[2]) AS rest FROM units u JOIN totals t USING (folder) LEFT JOIN subjects s USING (folder) WHERE u.topical)",
    ),
    "misfiled_best_profile": select(
        "SELECT folder, file_id, descendant, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY folder, file_id ORDER BY similarity DESC, distance, descendant) AS turn FROM pairs) WHERE turn = 1",
        UNITS, MEMBERS, MEANS, SUBJECTS, TREE,
        "profile_parts AS (SELECT folder, i, avg(x) AS x, count(*) AS n FROM (SELECT folder, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM units) GROUP BY folder, i)",
        "raw_profiles AS (SELECT folder, list(x ORDER BY i) AS p FROM profile_parts WHERE n >= 3 GROUP BY folder)",
        "unit_profiles AS (SELECT folder AS descendant, list_transform(p, lambda x: CASE WHEN sqrt(list_inner_product(p, p)) > 1e-8 THEN x / sqrt(list_inner_product(p, p)) ELSE 0 END) AS p FROM raw_profiles)",
        f"below AS (SELECT t.ancestor AS folder, t.descendant, t.distance, u.p FROM tree t JOIN unit_profiles u USING (descendant) LEFT JOIN subjects s ON s.folder = t.ancestor WHERE distance > 0 AND (s.subject IS NULL OR list_inner_product(u.p, s.subject) < {LIMITS.unrelated!r}))",
        "pairs AS (SELECT v.folder, v.file_id, b.descendant, b.distance, list_inner_product(v.vec, b.p) AS similarity FROM units v JOIN below b USING (folder))",
    ),
    "topic_separation": select(
        f"SELECT x.folder, count(*) AS pairs, round(avg({dot('x.mean', 'y.mean')}), 5) AS mean FROM mains x JOIN mains y ON x.folder = y.folder AND x.cluster < y.cluster GROUP BY x.folder",
        UNITS, MEMBERS, MEANS, "mains AS (SELECT means.* FROM means JOIN main USING (folder, cluster))",
    ),
    "shared_name_thread": select(
        "SELECT x.folder, x.cluster AS a, y.cluster AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM sets x JOIN sets y ON x.folder = y.folder AND x.cluster < y.cluster",
        LATEST, MEMBERS,
        f"name_toks AS (SELECT folder, file_id, unnest({name_words('stem')}) AS t FROM latest WHERE folder IS NOT NULL AND stem IS NOT NULL)",
        "sets AS (SELECT folder, cluster, list(DISTINCT t) AS t FROM name_toks JOIN members USING (folder, file_id) JOIN main USING (folder, cluster) GROUP BY folder, cluster)",
    ),
    "unattached_files": select(
        f"SELECT folder, readable, round(loose, 6) AS loose, loners, subjects, round({ramp('loose', 0.20, 0.95)}, 6) AS severity FROM (SELECT folder, count(*) AS readable, 1 - count(size) / count(*) AS loose, (count(*) - count(size))::BIGINT AS loners, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS subjects FROM eligible GROUP BY folder)",
        LATEST, KINDS, TEXTS, WRITTEN, UNITS, MEMBERS,
        "eligible AS (SELECT w.folder, m.cluster, x.size FROM written w JOIN units u ON w.folder = u.folder AND w.file_id = u.file_id JOIN members m ON m.folder = w.folder AND m.file_id = w.file_id LEFT JOIN main x ON x.folder = m.folder AND x.cluster = m.cluster WHERE u.topical AND length(w.text) >= 120)",
    ),
    "char_overlap_bound": select(
        "SELECT a, b, round(2 * sum(least(cx, cy)) / any_value(lx + ly), 6) AS bound FROM (SELECT a, b, lx, ly, ch, count(*) FILTER (side = 0) AS cx, count(*) FILTER (side = 1) AS cy FROM chars GROUP BY ALL) GROUP BY a, b",
        LATEST, KINDS, TEXTS, WRITTEN, UNITS,
        "excerpt AS (SELECT file_id, substring(text, 1, 2000) AS text FROM written WHERE text <> '')",
        f"near AS (SELECT x.file_id AS a, y.file_id AS b FROM units x JOIN units y ON x.folder = y.folder AND x.file_id < y.file_id WHERE {dot('x.vec', 'y.vec')} >= 0.9)",
        "alike AS (SELECT a, b, x.text AS tx, y.text AS ty, length(x.text) AS lx, length(y.text) AS ly FROM near JOIN excerpt x ON x.file_id = a JOIN excerpt y ON y.file_id = b WHERE 2.0 * least(length(x.text), length(y.text)) / (length(x.text) + length(y.text)) >= 0.9)",
        "chars AS (SELECT a, b, lx, ly, 0 AS side, unnest(regexp_extract_all(tx, '(?s).')) AS ch FROM alike UNION ALL SELECT a, b, lx, ly, 1, unnest(regexp_extract_all(ty, '(?s).')) FROM alike)",
    ),
    "label_separation": select(
        f"SELECT x.label, any_value(c.n) AS n, round(avg({dot('x.v', 'y.v')}) FILTER (x.label = y.label AND x.k <> y.k), 5) AS inside, round(avg({dot('x.v', 'y.v')}) FILTER (x.label <> y.label), 5) AS outside FROM vs x, vs y, counts c WHERE c.label = x.label AND c.n > 1 GROUP BY x.label",
        "vs AS (SELECT label, row_number() OVER () AS k, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL))",
        "counts AS (SELECT label, count(*) AS n FROM vs GROUP BY label)",
    ),
    "label_pairs": select(
        "SELECT count(*) AS pairs, round(quantile_cont(s, 0.5), 5) AS median, round(quantile_cont(s, 0.95), 5) AS p95, round(max(s), 5) AS highest, arg_max(a, s) AS closest_a, arg_max(b, s) AS closest_b FROM pairs",
        "vs AS (SELECT label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL))",
        "parts AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vs) GROUP BY label, i)",
        "raw AS (SELECT label, list(x ORDER BY i) AS m FROM parts GROUP BY label)",
        "means AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS m FROM raw)",
        "pairs AS (SELECT x.label AS a, y.label AS b, list_inner_product(x.m, y.m) AS s FROM means x JOIN means y ON x.label < y.label)",
    ),
    "era_gaps": select("SELECT folder, era::BIGINT AS era, count(*) AS files, round(min(t), 3) AS begin, round(max(t), 3) AS end FROM eras GROUP BY folder, era", LATEST, DATED),
    "event_eras": select(
        "SELECT user_id, era::BIGINT AS era, count(*) AS events, min(event_id) AS first, max(event_id) AS last FROM eras GROUP BY user_id, era HAVING count(*) >= 3",
        "steps AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 12 * 3600 * 1000000::BIGINT THEN 1 ELSE 0 END AS step FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)",
        "eras AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM steps)",
    ),
    "era_dominant": select("SELECT folder, era::BIGINT AS era, dominant FROM dominant", LATEST, DATED, MEMBERS, DOMINANT),
    "time_strata": select(
        f"SELECT folder, round(0.9 * {ramp('n', 1, 4)} * {ramp('d', 1, 3)}, 6) AS severity, first_count FROM shape JOIN apart USING (folder) JOIN firsts USING (folder) WHERE nearest < {LIMITS.unrelated!r} AND pairs = n * (n - 1) / 2",
        LATEST, DATED.replace("folder IS NOT NULL)", "folder IS NOT NULL AND stem IS NOT NULL AND folder IN (SELECT folder FROM latest WHERE stem IS NOT NULL GROUP BY folder HAVING count(*) >= 6))"), MEMBERS, DOMINANT, UNITS,
        "shape AS (SELECT folder, count(*) AS n, count(DISTINCT CASE WHEN dominant >= 0 THEN dominant END) AS d FROM dominant GROUP BY folder HAVING count(*) >= 2 AND d >= 2)",
        "everyone AS (SELECT e.folder, e.era, e.file_id, m.cluster, d.dominant, u.vec, u.topical FROM eras e JOIN members m USING (folder, file_id) JOIN dominant d USING (folder, era) JOIN units u USING (folder, file_id))",
        "own AS (SELECT * FROM everyone WHERE cluster = dominant)",
        "chosen AS (SELECT folder, era, vec FROM own UNION ALL SELECT folder, era, vec FROM everyone WHERE topical AND (folder, era) NOT IN (SELECT folder, era FROM own))",
        "era_parts AS (SELECT folder, era, i, avg(x) AS x FROM (SELECT folder, era, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM chosen) GROUP BY folder, era, i)",
        "era_raw AS (SELECT folder, era, list(x ORDER BY i) AS p FROM era_parts GROUP BY folder, era)",
        "era_units AS (SELECT folder, era, list_transform(p, lambda x: CASE WHEN sqrt(list_inner_product(p, p)) > 1e-8 THEN x / sqrt(list_inner_product(p, p)) ELSE 0 END) AS p FROM era_raw)",
        "apart AS (SELECT x.folder, max(list_inner_product(x.p, y.p)) AS nearest, count(*) AS pairs FROM era_units x JOIN era_units y ON x.folder = y.folder AND x.era < y.era GROUP BY x.folder)",
        "firsts AS (SELECT folder, arg_min(c, (f, l)) AS first_count FROM (SELECT folder, era, count(*) AS c, min(t) AS f, max(t) AS l FROM eras JOIN members USING (folder, file_id) GROUP BY folder, era) GROUP BY folder)",
    ),
    "overcrowded": select(f"SELECT folder, count, round({ramp('count', 40, 240)}, 6) AS severity FROM (SELECT folder, count(*) AS count FROM latest WHERE folder IS NOT NULL GROUP BY folder) WHERE count > 40", LATEST),
    "severity_ramp": f"SELECT folder, round({ramp('n_files', 2, 12)}, 6) AS few, round({ramp('n_files', 40, 240)}, 6) AS many, round({ramp('n_files', 5, 5)}, 6) AS step FROM folders WHERE n_files IS NOT NULL",
    "score_family_max": select("SELECT folder, round(score, 6) AS score FROM scored", LATEST, DEBRIS, FAMILIES_SQL, SIMPLE),
    "verdict_bands": select(f"SELECT *, {LABELS} AS label FROM verdicts", LATEST, DEBRIS, FAMILIES_SQL, SIMPLE),
    "visibility_filter": select("SELECT folder, judged, verdict FROM verdicts WHERE NOT judged OR verdict >= 1", LATEST, DEBRIS, FAMILIES_SQL, SIMPLE),
    "worst_verdicts": select(f"SELECT folder, score, verdict, printf('%.1f', score) || chr(9) || {LABELS} || chr(9) || folder AS report FROM verdicts WHERE judged ORDER BY score DESC, folder", LATEST, DEBRIS, FAMILIES_SQL, SIMPLE),
    "misfiled_sweep": select(
        "SELECT ratio, count(DISTINCT folder) AS folders, coalesce(sum(n), 0)::BIGINT AS files FROM grid LEFT JOIN hits USING (ratio) GROUP BY ratio",
        UNITS, MEMBERS, MEANS, SUBJECTS, TREE,
        "parts AS (SELECT folder, i, sum(x) AS x, count(*) AS n FROM (SELECT folder, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM units WHERE topical) GROUP BY folder, i)",
        "totals AS (SELECT folder, list(x ORDER BY i) AS total FROM parts WHERE n >= 2 GROUP BY folder)",
        "rests AS (SELECT u.folder, u.file_id, u.vec, s.subject, list_transform(list_zip(t.total, u.vec), lambda p: p[1] - p[2]) AS rest FROM units u JOIN totals t USING (folder) LEFT JOIN subjects s USING (folder) WHERE u.topical)",
        f"loose AS (SELECT * FROM rests WHERE list_inner_product(vec, coalesce(subject, list_transform(rest, lambda x: CASE WHEN sqrt(list_inner_product(rest, rest)) > 1e-8 THEN x / sqrt(list_inner_product(rest, rest)) ELSE 0 END))) < {LIMITS.cluster!r})",
        "profile_parts AS (SELECT folder, i, avg(x) AS x, count(*) AS n FROM (SELECT folder, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM units) GROUP BY folder, i)",
        "raw_profiles AS (SELECT folder, list(x ORDER BY i) AS p FROM profile_parts WHERE n >= 3 GROUP BY folder)",
        "unit_profiles AS (SELECT folder AS descendant, list_transform(p, lambda x: CASE WHEN sqrt(list_inner_product(p, p)) > 1e-8 THEN x / sqrt(list_inner_product(p, p)) ELSE 0 END) AS p FROM raw_profiles)",
        f"below AS (SELECT t.ancestor AS folder, t.descendant, t.distance, u.p FROM tree t JOIN unit_profiles u USING (descendant) LEFT JOIN subjects s ON s.folder = t.ancestor WHERE distance > 0 AND (s.subject IS NULL OR list_inner_product(u.p, s.subject) < {LIMITS.unrelated!r}))",
        "ranked AS (SELECT v.folder, v.file_id, b.descendant, list_inner_product(v.vec, b.p) AS similarity, row_number() OVER (PARTITION BY v.folder, v.file_id ORDER BY list_inner_product(v.vec, b.p) DESC, b.distance, b.descendant) AS turn FROM loose v JOIN below b USING (folder))",
        "grid(ratio) AS (SELECT round(0.05::DOUBLE * k, 2) FROM (SELECT unnest(range(17)) AS k))",
        f"hits AS (SELECT ratio, folder, descendant, count(*) AS n FROM ranked, grid WHERE turn = 1 AND similarity >= {LIMITS.cluster!r} - ratio * 0.9 GROUP BY ratio, folder, descendant HAVING count(*) >= 2)",
    ),
    "median_of_medians": "SELECT source, round(quantile_cont(m, 0.5), 6) AS median FROM (SELECT source, lang, quantile_cont(n_chars, 0.5) AS m FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang) GROUP BY source",
    "cache_eviction": "SELECT path, size, mtime, settings, max(accessed) AS accessed FROM extracted WHERE path IS NOT NULL GROUP BY path, size, mtime, settings ORDER BY accessed DESC, path, size, mtime, settings LIMIT 100000",
    "cache_vectors": "SELECT model, digest, (x).a AS accessed, (x).d AS dimensions FROM (SELECT model, digest, max({a: accessed, d: dimensions}) AS x FROM embedding_cache WHERE digest IS NOT NULL GROUP BY model, digest) ORDER BY accessed DESC, model, digest LIMIT 250000",
    "cache_lookup": select(
        "SELECT file_id, t.path IS NOT NULL AS cached FROM latest l LEFT JOIN texts_held t ON l.path = t.path AND l.size = t.size AND t.seconds = coalesce(epoch_us(l.mtime), 0) / 1e6 AND l.mtime IS NOT NULL WHERE l.path IS NOT NULL",
        LATEST,
        # A hexadecimal float: 1 and 13 digits behind the point, times a power of two.
        "keys AS (SELECT DISTINCT path, size, mtime FROM extracted WHERE settings = 's7f3a1c' AND text IS NOT NULL AND mtime LIKE '0x1.%p+%')",
        "texts_held AS (SELECT path, size, (1 + ('0x' || regexp_extract(mtime, '\\.([0-9a-f]{13})p', 1))::BIGINT / 4503599627370496.0::DOUBLE) * power(2, regexp_extract(mtime, 'p\\+([0-9]+)$', 1)::INT) AS seconds FROM keys)",
    ),
    "greedy_unrelated": select("SELECT folder, cluster, size, turn FROM chosen", LATEST, MEMBERS, MAIN, UNITS, MEANS, RELATED, GREEDY, CHOSEN),
    "unrelated_topics": select(
        f"""SELECT folder, topics::INT AS topics, round(coverage, 3) AS coverage, round(greatest(0, least(1, (1 - power(0.45, topics - 1)) * (0.5 + 0.5 * coverage) * (0.8 + 0.2 * greatest(0, least(1, separation))))), 6) AS severity
          FROM (SELECT folder, topics, covered / greatest(1, n_files) AS coverage, 1 - greatest(0, near) / {max(1e-6, LIMITS.unrelated)!r} AS separation FROM several JOIN apart USING (folder) JOIN file_counts USING (folder)) WHERE separation >= 0.10""",
        LATEST, MEMBERS, MAIN, UNITS, MEANS, RELATED, GREEDY, CHOSEN,
        "several AS (SELECT folder, count(*) AS topics, sum(size) AS covered FROM chosen GROUP BY folder HAVING count(*) >= 2)",
        "apart AS (SELECT a.folder, avg(a.similarity) AS near FROM alike a JOIN chosen x ON x.folder = a.folder AND x.cluster = a.a JOIN chosen y ON y.folder = a.folder AND y.cluster = a.b GROUP BY a.folder)",
    ),
    "stray_files": select(
        f"SELECT folder, CASE WHEN loose >= 0.65 THEN 'no_common_thread' ELSE 'strays' END AS code, loners AS count, round(loose, 3) AS loose_fraction, round({ramp('loose', 0.20, 0.95)}, 6) AS severity FROM stray WHERE readable >= 6 AND loners >= 3 AND {ramp('loose', 0.20, 0.95)} > 0",
        LATEST, KINDS, TEXTS, WRITTEN, UNITS, MEMBERS, MAIN,
        "eligible AS (SELECT w.folder, m.cluster, x.size FROM written w JOIN units u ON w.folder = u.folder AND w.file_id = u.file_id JOIN members m ON m.folder = w.folder AND m.file_id = w.file_id LEFT JOIN chief_clusters x ON x.folder = m.folder AND x.cluster = m.cluster WHERE u.topical AND length(w.text) >= 120 AND w.stem IS NOT NULL)",
        "stray AS (SELECT folder, count(*) AS readable, 1 - count(size) / count(*) AS loose, (count(*) - count(size))::BIGINT AS loners FROM eligible GROUP BY folder)",
    ),
    "unrelated_sweep": select(
        "SELECT ratio, count(*) AS folders, sum(fires)::BIGINT AS firing, sum(fires * n)::BIGINT AS topics FROM judged GROUP BY ratio",
        LATEST, MEMBERS, "chief_clusters AS (SELECT * FROM main)", UNITS, MEANS, RELATED,
        "grid(ratio) AS (SELECT round(0.2::DOUBLE + 0.05::DOUBLE * k, 2) FROM (SELECT unnest(range(17)) AS k))",
        "ordered AS (SELECT folder, cluster, size, row_number() OVER (PARTITION BY folder ORDER BY size DESC, cluster) AS k, count(*) OVER (PARTITION BY folder) AS n FROM chief_clusters)",
        "near AS (SELECT ratio, folder, c, list(o) AS related FROM (SELECT folder, a AS c, b AS o, similarity, thread FROM threads UNION ALL SELECT folder, b, a, similarity, thread FROM threads), grid WHERE thread OR similarity >= ratio * 0.9 GROUP BY ratio, folder, c)",
        "walk AS (SELECT ratio, folder, k, [cluster] AS taken FROM ordered, grid WHERE k = 1 AND n >= 2 UNION ALL SELECT w.ratio, w.folder, o.k, CASE WHEN list_has_any(w.taken, coalesce(x.related, [])) THEN w.taken ELSE list_append(w.taken, o.cluster) END FROM walk w JOIN ordered o ON o.folder = w.folder AND o.k = w.k + 1 LEFT JOIN near x ON x.ratio = w.ratio AND x.folder = o.folder AND x.c = o.cluster)",
        "ends AS (SELECT ratio, folder, arg_max(taken, k) AS taken FROM walk GROUP BY ratio, folder)",
        "judged AS (SELECT e.ratio, e.folder, len(taken) AS n, CASE WHEN len(taken) > 1 AND count(a.similarity) > 0 AND 1 - greatest(0, avg(a.similarity)) / greatest(1e-6, e.ratio * 0.9) >= 0.10 THEN 1 ELSE 0 END AS fires FROM ends e LEFT JOIN alike a ON a.folder = e.folder AND list_contains(taken, a.a) AND list_contains(taken, a.b) GROUP BY e.ratio, e.folder, taken)",
    ),
    "read_formats": values("name, text", [(n, t) for n, _, t in planted.FORMATS]),
    "report_lines": values("folder, line", planted.EXPECTED_LINES),
    "report_json": values("path, files, score, verdict, found, worst, truncated, skip_reason", planted.EXPECTED_JSON),
    "planted_duplicates": values("folder, exact, near", planted.EXPECTED_COPIES),
    "planted_near_duplicates": values("folder, name_a, name_b", planted.EXPECTED_EDITS),
    "planted_misfiled": values("folder, below, files", planted.EXPECTED_MISFILED),
    "planted_placement": values("folder, related", planted.EXPECTED_PLACEMENT),
}


def _census() -> str:
    """Over the SQL of the signals; copies and misfiled files have none, and the small tables hold no case of them."""
    parts = [select("SELECT folder, code, round(severity, 6) AS severity FROM found", LATEST, DEBRIS, FAMILIES_SQL, SIMPLE)]
    parts += [f"SELECT folder, {code}, severity FROM ({SQL[name]})" for name, code in (("time_strata", "'time_strata'"), ("unrelated_topics", "'unrelated_topics'"), ("stray_files", "code"))]
    every = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"SELECT code, count(DISTINCT folder) AS folders, round(avg(severity), 6) AS mean_severity FROM ({every}) GROUP BY code"


SQL["finding_census"] = _census()
