"""DuckDB twins of the analog views and queries (the correctness oracle).

``sql(name)`` returns one SQL string with a WITH clause holding exactly the
views the query needs, in dependency order.  The base tables (orders, customer,
lineitem, ...) are views the checker registers over the same Parquet files.
"""

from __future__ import annotations

from ..operators.structure import HTML_TAG_KINDS, JAVA_RULES, TAG_PATTERN
from ..sources.analogs import PROJECTS

# name -> (dependencies, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *deps: str):
    def register(body: str) -> str:
        VIEWS[name] = (deps, body)
        return body
    return register


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order) + "\n"


view("commits")("""
SELECT c.c_mktsegment AS project, CAST(o.o_orderkey AS VARCHAR) AS sha,
       'dev' || CAST(o.o_custkey % 50 AS VARCHAR) AS author, o.o_orderdate AS committed_at,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'fix ' || lower(c.c_mktsegment) || '-' || CAST(o.o_orderkey AS VARCHAR)
            WHEN o.o_orderkey % 7 = 1 THEN 'see ' || c.c_mktsegment || '-' || CAST(o.o_orderkey - 1 AS VARCHAR)
            ELSE 'tidy' END AS message
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")

view("release_quarters", "commits")("""
SELECT project, year(committed_at) * 10 + quarter(committed_at) AS qkey,
       max(CAST(committed_at AS DATE)) AS release_date
FROM commits GROUP BY 1, 2""")

view("releases", "release_quarters")("""
SELECT project, project || '-' || CAST(qkey AS VARCHAR) AS release_id,
       '1.' || CAST(ord - 1 AS VARCHAR) AS name, release_date
FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY qkey) AS ord,
             count(*) OVER (PARTITION BY project) AS n FROM release_quarters) q
WHERE ord <= n - 2""")

view("release_ord", "releases")("""
SELECT *, row_number() OVER (PARTITION BY project ORDER BY release_date, release_id) AS ord,
       count(*) OVER (PARTITION BY project) AS n_releases
FROM releases""")

# J-1 in SQL: smallest release date on/after the commit day, else the last one.
view("commit_release", "commits", "release_ord")("""
SELECT c.*, r.release_id, r.release_date, r.ord
FROM (SELECT c.*, coalesce(
        (SELECT min(r.release_date) FROM release_ord r
          WHERE r.project = c.project AND r.release_date >= CAST(c.committed_at AS DATE)),
        (SELECT max(r.release_date) FROM release_ord r WHERE r.project = c.project)) AS rd
      FROM commits c) c
LEFT JOIN release_ord r ON r.project = c.project AND r.release_date = c.rd""")

view("file_changes", "commits")("""
SELECT c.project, f.sha, f.path,
       CASE WHEN f.r_ = 1 THEN 'MODIFY' WHEN f.a_ = 1 THEN 'ADD' ELSE 'DELETE' END AS change_type, f.added, f.deleted
FROM (SELECT sha, path, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r_,
             max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a_,
             CAST(sum(l_quantity) AS BIGINT) AS added, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS deleted
      FROM (SELECT CAST(l_orderkey AS VARCHAR) AS sha,
                   'core/src/' || CASE WHEN l_suppkey % 10 = 0 THEN 'test/' WHEN l_suppkey % 10 = 1 THEN 'main/test/'
                                       ELSE 'main/' END
                   || 'F' || CAST(l_partkey % 200 AS VARCHAR) || CASE WHEN l_suppkey % 10 = 2 THEN '.kt' ELSE '.java' END AS path,
                   l_quantity, l_discount, l_returnflag FROM lineitem) x
      GROUP BY sha, path) f
JOIN commits c ON c.sha = f.sha""")

view("snapshots", "file_changes", "commits", "release_ord")("""
SELECT ft.project, r.release_id, r.release_date, r.ord, ft.path
FROM (SELECT f.project, f.path, min(CAST(c.committed_at AS DATE)) AS first_day
      FROM file_changes f JOIN commits c ON c.project = f.project AND c.sha = f.sha GROUP BY 1, 2) ft
JOIN release_ord r ON r.project = ft.project AND r.release_date >= ft.first_day""")

view("java_snapshots", "snapshots")("""
SELECT * FROM snapshots WHERE ends_with(path, '.java') AND NOT contains(path, '/src/test/')""")


view("issues", "commits", "releases")("""
SELECT a.project, a.ticket_key, a.created, a.resolved,
       CASE WHEN a.k_ % 40 = 11 THEN list_concat(['0.0-unknown'], CASE WHEN r.name IS NULL THEN []::VARCHAR[] ELSE [r.name] END)
            ELSE CASE WHEN r.name IS NULL THEN []::VARCHAR[] ELSE [r.name] END END AS affected_names
FROM (SELECT b.*, (SELECT min(r.release_date) FROM releases r
                    WHERE r.project = b.project AND r.release_date >= b.probe) AS av_date
      FROM (SELECT *, CASE WHEN k_ % 30 = 0 THEN day_ + 120 WHEN k_ % 3 = 0 THEN created - 150 END AS probe
            FROM (SELECT c.c_mktsegment AS project, c.c_mktsegment || '-' || CAST(o.o_orderkey AS VARCHAR) AS ticket_key,
                         CAST(o.o_orderdate AS DATE) - CAST(o.o_orderkey % 200 AS INTEGER) AS created,
                         CASE WHEN (o.o_orderkey // 7) % 50 = 7 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS resolved,
                         CAST(o.o_orderdate AS DATE) AS day_, o.o_orderkey // 7 AS k_
                  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                  WHERE o.o_orderkey % 7 = 0) x) b) a
LEFT JOIN releases r ON r.project = a.project AND r.release_date = a.av_date""")

view("affected", "issues", "releases")("""
SELECT i.project, i.ticket_key, r.release_date, r.release_id,
       row_number() OVER (PARTITION BY i.project, i.ticket_key ORDER BY r.release_date, r.release_id) AS av_pos
FROM (SELECT project, ticket_key, unnest(affected_names) AS name FROM issues) i
JOIN releases r ON r.project = i.project AND r.name = i.name""")

view("ticket_versions", "issues", "release_ord", "affected")("""
SELECT t.project, t.ticket_key, t.created, t.resolved,
       ro.release_id AS ov_release_id, t.ov_date AS ov_release_date, ro.ord AS ov_ord,
       rf.release_id AS fv_release_id, t.fv_date AS fv_release_date, rf.ord AS fv_ord,
       coalesce(a.n_av, 0) AS n_av, a.first_id AS iv_release_id, a.first_date AS iv_release_date, ri.ord AS iv_ord,
       CASE WHEN ro.release_id IS NULL THEN 'no_opening_version'
            WHEN rf.release_id IS NULL THEN 'no_fixed_version'
            WHEN t.ov_date > t.fv_date THEN 'opening_after_fixed'
            WHEN a.n_av > 0 AND t.ov_date < a.first_date THEN 'opening_before_first_affected'
            WHEN a.n_av > 0 AND t.fv_date <= a.last_date THEN 'fixed_not_after_last_affected' END AS reject_reason
FROM (SELECT i.*,
        (SELECT min(r.release_date) FROM release_ord r WHERE r.project = i.project AND r.release_date >= i.created) AS ov_date,
        (SELECT min(r.release_date) FROM release_ord r WHERE r.project = i.project AND r.release_date >= i.resolved) AS fv_date
      FROM issues i WHERE i.resolved IS NOT NULL) t
LEFT JOIN release_ord ro ON ro.project = t.project AND ro.release_date = t.ov_date
LEFT JOIN release_ord rf ON rf.project = t.project AND rf.release_date = t.fv_date
LEFT JOIN (SELECT project, ticket_key, count(*) AS n_av,
                  max(CASE WHEN av_pos = 1 THEN release_id END) AS first_id,
                  max(CASE WHEN av_pos = 1 THEN release_date END) AS first_date,
                  max(release_date) AS last_date
           FROM affected GROUP BY 1, 2) a ON a.project = t.project AND a.ticket_key = t.ticket_key
LEFT JOIN release_ord ri ON ri.project = t.project AND ri.release_id = a.first_id""")

view("valid_tickets", "ticket_versions")("""
SELECT *, CASE WHEN iv_release_date IS NOT NULL AND fv_release_date - ov_release_date > 0
               THEN CAST(fv_release_date - iv_release_date AS DOUBLE) / (fv_release_date - ov_release_date) END AS p_
FROM ticket_versions WHERE reject_reason IS NULL""")

view("proportion", "valid_tickets")("""
SELECT project, n_known, n_computable, p_mean, p_cold,
       CASE WHEN n_known >= 5 THEN p_mean ELSE p_cold END AS p_used,
       CASE WHEN n_known >= 5 THEN 'mean' ELSE 'cold_start' END AS method
FROM (SELECT p.*, coalesce((SELECT median(o.p_mean) FROM
                              (SELECT project, coalesce(avg(CASE WHEN p_ >= 0 THEN p_ END), -1.0) AS p_mean
                               FROM valid_tickets GROUP BY project) o
                            WHERE o.project <> p.project AND o.p_mean >= 0), 0.5) AS p_cold
      FROM (SELECT project, count(iv_release_id) AS n_known, count(CASE WHEN p_ >= 0 THEN 1 END) AS n_computable,
                   coalesce(avg(CASE WHEN p_ >= 0 THEN p_ END), -1.0) AS p_mean
            FROM valid_tickets GROUP BY project) p) q""")


view("final_tickets", "proportion", "release_ord")("""
WITH est AS (
  SELECT v.*, v.fv_release_date - CAST(trunc((v.fv_release_date - v.ov_release_date) * p.p_used) AS INTEGER) AS est_day
  FROM valid_tickets v JOIN proportion p ON p.project = v.project WHERE v.iv_release_id IS NULL),
est_rel AS (
  SELECT e.*, coalesce((SELECT min(r.release_date) FROM release_ord r WHERE r.project = e.project AND r.release_date >= e.est_day),
                       (SELECT max(r.release_date) FROM release_ord r WHERE r.project = e.project)) AS e_date
  FROM est e),
allv AS (
  SELECT e.project, e.ticket_key, r.release_id AS iv_release_id, r.release_date AS iv_release_date, e.fv_release_id,
         e.fv_release_date, TRUE AS estimated, e.fv_ord - r.ord AS n_affected
  FROM est_rel e JOIN release_ord r ON r.project = e.project AND r.release_date = e.e_date
  UNION ALL
  SELECT project, ticket_key, iv_release_id, iv_release_date, fv_release_id, fv_release_date, FALSE, n_av
  FROM valid_tickets WHERE iv_release_id IS NOT NULL)
SELECT * FROM allv WHERE iv_release_date <= fv_release_date""")

view("fixing", "commit_release", "final_tickets")("""
SELECT c.* FROM (SELECT *, upper(nullif(regexp_extract(message, '(?i)' || project || '-[0-9]+'), '')) AS ticket_key
                 FROM commit_release) c
WHERE c.ticket_key IN (SELECT upper(t.ticket_key) FROM final_tickets t WHERE t.project = c.project)""")

view("fix_files", "fixing", "file_changes")("""
SELECT f.project, f.sha, f.path FROM file_changes f
WHERE f.change_type IN ('ADD', 'MODIFY') AND ends_with(f.path, '.java')
  AND NOT contains(f.path, '/test/') AND NOT contains(f.path, '/src/test/')
  AND EXISTS (SELECT 1 FROM fixing x WHERE x.project = f.project AND x.sha = f.sha)""")

view("links", "fixing", "final_tickets", "commit_release")("""
SELECT DISTINCT x.project, x.sha, x.release_id AS fix_release_id, t.iv_release_id
FROM fixing x JOIN final_tickets t ON t.project = x.project AND upper(t.ticket_key) = x.ticket_key
WHERE EXISTS (SELECT 1 FROM commit_release c WHERE c.project = x.project AND c.release_id = t.iv_release_id)""")

view("links_release", "fixing", "final_tickets", "commit_release")("""
SELECT DISTINCT x.project, x.sha, x.release_id AS fix_release_id, t.iv_release_id
FROM fixing x JOIN final_tickets t ON t.project = x.project AND t.fv_release_id = x.release_id
WHERE EXISTS (SELECT 1 FROM commit_release c WHERE c.project = x.project AND c.release_id = t.iv_release_id)""")

view("intervals", "links", "fix_files", "releases")("""
SELECT DISTINCT f.project, f.path, ri.release_date AS iv_date, rf.release_date AS fv_date
FROM fix_files f JOIN links l ON l.project = f.project AND l.sha = f.sha
JOIN releases ri ON ri.project = l.project AND ri.release_id = l.iv_release_id
JOIN releases rf ON rf.project = l.project AND rf.release_id = l.fix_release_id""")

view("labelled", "java_snapshots", "intervals")("""
SELECT s.*, EXISTS (SELECT 1 FROM intervals i WHERE i.project = s.project AND i.path = s.path
                    AND i.iv_date <= s.release_date AND s.release_date < i.fv_date) AS buggy
FROM java_snapshots s""")

view("touched", "file_changes", "commit_release")("""
SELECT f.project, f.path, f.sha, f.added, f.deleted, c.author, c.committed_at, c.ord,
       row_number() OVER (PARTITION BY f.project, f.path ORDER BY c.committed_at, f.sha) AS rn
FROM file_changes f JOIN commit_release c ON c.project = f.project AND c.sha = f.sha
WHERE ends_with(f.path, '.java') AND NOT contains(f.path, '/src/test/')""")

view("file_churn", "touched", "java_snapshots")("""
SELECT s.project, s.release_id, s.path, count(DISTINCT t.sha) AS revisions, count(DISTINCT t.author) AS authors,
       CAST(coalesce(sum(CASE WHEN t.rn > 1 THEN t.added + t.deleted END), 0) AS BIGINT) AS total_churn,
       CAST(coalesce(max(CASE WHEN t.rn > 1 THEN t.added END), 0) AS BIGINT) AS max_churn,
       coalesce(avg(CASE WHEN t.rn > 1 THEN t.added END), 0.0) AS avg_churn
FROM java_snapshots s LEFT JOIN touched t ON t.project = s.project AND t.path = s.path AND t.ord <= s.ord
GROUP BY s.project, s.release_id, s.path""")


_TAG_CASE = "CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in HTML_TAG_KINDS) + " ELSE name END"
_RULES = "VALUES " + ", ".join("('%s', %d, %d, %d, %d, %d)" % r for r in JAVA_RULES)

view("page_events")(f"""
SELECT page_id, seq, {_TAG_CASE} AS kind, CASE WHEN starts_with(tag, '</') THEN 'exit' ELSE 'enter' END AS phase
FROM (SELECT page_id, seq, tag, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name
      FROM (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS seq
            FROM (SELECT page_id, regexp_extract_all(html, '{TAG_PATTERN}') AS tags FROM pages) a) b) c""")

view("page_metrics", "page_events")(f"""
SELECT p.page_id AS method_ord, m.n_nodes, m.params, m.cyclomatic, m.nesting, m.cognitive,
       {{line_count('p.html')}} AS loc
FROM pages p LEFT JOIN (
  SELECT page_id, count(CASE WHEN phase = 'enter' THEN 1 END) AS n_nodes,
         count(CASE WHEN phase = 'enter' AND kind = 'param' THEN 1 END) AS params,
         CAST(1 + coalesce(sum(CASE WHEN phase = 'enter' THEN cyclo END), 0) AS BIGINT) AS cyclomatic,
         CAST(greatest(coalesce(max(depth), 0), 0) AS BIGINT) AS nesting,
         CAST(coalesce(sum(CASE WHEN phase = 'enter' THEN cog_flat + cog_nested * (level_after - l_) END), 0) AS BIGINT)
           AS cognitive
  FROM (SELECT e.*, sum(d_) OVER w AS depth, sum(l_) OVER w AS level_after
        FROM (SELECT e.page_id, e.seq, e.kind, e.phase, coalesce(r.cyclo, 0) AS cyclo,
                     coalesce(r.cog_flat, 0) AS cog_flat, coalesce(r.cog_nested, 0) AS cog_nested,
                     CASE WHEN e.phase = 'enter' THEN 1 ELSE -1 END * coalesce(r.opens_depth, 0) AS d_,
                     CASE WHEN e.phase = 'enter' THEN 1 ELSE -1 END * coalesce(r.opens_level, 0) AS l_
              FROM page_events e LEFT JOIN ({_RULES}) r(kind, cyclo, opens_depth, opens_level, cog_flat, cog_nested)
                ON r.kind = e.kind) e
        WINDOW w AS (PARTITION BY page_id ORDER BY seq, CASE WHEN phase = 'enter' THEN 1 ELSE 0 END
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x
  GROUP BY page_id) m ON m.page_id = p.page_id""".replace("{line_count('p.html')}", "{LC_p}"))

view("page_methods")("""
SELECT page_id AS method_ord, 'F' || CAST(page_id % 200 AS VARCHAR) AS class, 'm' || CAST(page_id % 100 AS VARCHAR) AS simple_name,
       'm' || CAST(page_id % 100 AS VARCHAR) || '(' || CAST(page_id AS VARCHAR) || ')' AS signature
FROM pages""")

view("methods", "java_snapshots", "page_methods")(r"""
SELECT s.project, s.release_id, s.path, m.method_ord, m.simple_name, m.signature
FROM java_snapshots s JOIN page_methods m ON m.class = regexp_replace(regexp_extract(s.path, '([^/]*)$', 1), '\.java$', '')""")

view("violations")(f"""
SELECT ({list(PROJECTS)!r})[user_id % 5 + 1] AS project, '1.' || CAST(event_id % 26 AS VARCHAR) AS release_name,
       'F' || CAST(user_id % 200 AS VARCHAR) AS class, 'm' || json_extract_string(props, '$.k') AS method,
       'R' || CAST(event_id % 4 AS VARCHAR) AS rule, CAST(event_id % 100 AS INTEGER) AS beginline
FROM events WHERE event_type = 'error'""")

view("smells", "violations", "methods", "releases")(r"""
SELECT c.project, c.release_id, c.path, c.method_ord, count(*) AS n_smells
FROM (SELECT v.project, r.release_id, v.class, v.method FROM violations v
      JOIN releases r ON r.project = v.project AND r.name = v.release_name) v
JOIN (SELECT m.project, m.release_id, m.class, m.simple_name, min(m.method_ord) AS method_ord, min(m.path) AS path
      FROM (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.java$', '') AS class FROM methods) m
      JOIN (SELECT project, release_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.java$', '') AS class,
                   min(path) AS path FROM methods GROUP BY 1, 2, 3) f
        ON f.project = m.project AND f.release_id = m.release_id AND f.class = m.class AND f.path = m.path
      GROUP BY 1, 2, 3, 4) c
  ON c.project = v.project AND c.release_id = v.release_id AND c.class = v.class AND c.simple_name = v.method
GROUP BY 1, 2, 3, 4""")

view("range_smells", "violations", "methods", "releases")(r"""
SELECT project, release_id, path, method_ord, count(*) AS n_smells
FROM (SELECT v.project, v.release_id, m.path, m.method_ord, row_number() OVER (
               PARTITION BY v.event_id ORDER BY m.end_line - m.begin_line, m.begin_line DESC, m.method_ord) AS place
      FROM (SELECT row_number() OVER () AS event_id, v.project, r.release_id, v.class, v.beginline FROM violations v
            JOIN releases r ON r.project = v.project AND r.name = v.release_name) v
      JOIN (SELECT s.*, p.page_id % 100 AS begin_line, p.page_id % 100 + length(coalesce(p.html, '')) // 500 AS end_line
            FROM (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.java$', '') AS class FROM methods) s
            JOIN pages p ON p.page_id = s.method_ord) m
        ON m.project = v.project AND m.release_id = v.release_id AND m.class = v.class
           AND v.beginline BETWEEN m.begin_line AND m.end_line
      JOIN (SELECT project, release_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.java$', '') AS class,
                   min(path) AS path FROM methods GROUP BY 1, 2, 3) f
        ON f.project = m.project AND f.release_id = m.release_id AND f.class = m.class AND f.path = m.path) x
WHERE place = 1 GROUP BY 1, 2, 3, 4""")

view("dataset", "methods", "page_metrics", "file_churn", "labelled", "smells", "releases")("""
SELECT m.project AS ProjectName, r.name AS Release, m.path || '/' || m.signature AS MethodName,
       CAST(coalesce(pm.loc, 0) AS BIGINT) AS LOC, CAST(coalesce(pm.params, 0) AS BIGINT) AS ParameterCount,
       CAST(coalesce(pm.cyclomatic, 0) AS BIGINT) AS CycloComplexity,
       CAST(coalesce(pm.cognitive, 0) AS BIGINT) AS CognitiveComplexity,
       CAST(coalesce(pm.nesting, 0) AS BIGINT) AS NestingDepth,
       CAST(coalesce(ch.revisions, 0) AS BIGINT) AS Revisions, CAST(coalesce(ch.authors, 0) AS BIGINT) AS Authors,
       CAST(coalesce(ch.total_churn, 0) AS BIGINT) AS TotalChurn, CAST(coalesce(ch.max_churn, 0) AS BIGINT) AS MaxChurn,
       coalesce(ch.avg_churn, 0.0) AS AvgChurn, CAST(coalesce(sm.n_smells, 0) AS BIGINT) AS NumberOfCodeSmells,
       CASE WHEN coalesce(lb.buggy, FALSE) THEN 'yes' ELSE 'no' END AS Bugginess
FROM methods m
LEFT JOIN page_metrics pm ON pm.method_ord = m.method_ord
LEFT JOIN file_churn ch ON ch.project = m.project AND ch.release_id = m.release_id AND ch.path = m.path
LEFT JOIN labelled lb ON lb.project = m.project AND lb.release_id = m.release_id AND lb.path = m.path
LEFT JOIN smells sm ON sm.project = m.project AND sm.release_id = m.release_id AND sm.path = m.path
     AND sm.method_ord = m.method_ord
JOIN releases r ON r.project = m.project AND r.release_id = m.release_id""")


view("method_rows")("""
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS id,
       'p' || CAST(l_suppkey % 5 AS VARCHAR) AS Project, '1.' || CAST(year(l_shipdate) AS VARCHAR) AS Release,
       l_quantity AS LOC, round(l_discount * 100) AS NestingDepth, round(l_tax * 100) AS ParameterCount,
       l_extendedprice AS TotalChurn, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS ReturnFlag,
       CASE WHEN b THEN 'yes' ELSE 'no' END AS Bugginess, CAST(b AS INTEGER) AS buggy
FROM (SELECT *, 0.02 * l_quantity + 0.08 * round(l_discount * 100)
                + CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-42'), 1, 8))
                       AS BIGINT) / 4294967296.0 > 1.6 AS b
      FROM lineitem) x""")

ML_FEATURES = ("LOC", "NestingDepth", "ParameterCount", "TotalChurn", "ReturnFlag")

view("ml_long", "method_rows")("\nUNION ALL\n".join(
    f"SELECT id, buggy, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM method_rows" for f in ML_FEATURES))

view("spearman", "ml_long")("""
SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM (
  SELECT feature, (rank() OVER (PARTITION BY feature ORDER BY value)
                   + count(*) OVER (PARTITION BY feature, value) - 1 + rank() OVER (PARTITION BY feature ORDER BY value)) / 2.0 AS rx,
                  (rank() OVER (PARTITION BY feature ORDER BY buggy)
                   + count(*) OVER (PARTITION BY feature, buggy) - 1 + rank() OVER (PARTITION BY feature ORDER BY buggy)) / 2.0 AS ry
  FROM ml_long WHERE value IS NOT NULL) x
GROUP BY feature""")

view("feature_ranking", "spearman")("""
SELECT row_number() OVER (ORDER BY abs(rho) DESC, feature) AS rank, feature, rho AS spearman_rho,
       lower(regexp_replace(feature, '[^a-zA-Z0-9]', '', 'g')) IN ('numberofcodesmells', 'cyclocomplexity', 'loc',
             'cognitivecomplexity', 'parametercount', 'nestingdepth') AS actionable
FROM spearman WHERE rho IS NOT NULL AND NOT isnan(rho)""")


view("folds", "method_rows")("""
SELECT id, buggy, rep, CAST((row_number() OVER (PARTITION BY rep, buggy
                                    ORDER BY md5(id || '-' || CAST(rep AS VARCHAR) || '-42'), id) - 1) % 5 AS INTEGER) AS fold
FROM method_rows, (SELECT CAST(range AS INTEGER) AS rep FROM range(2)) r""")


view("predictions", "folds", "method_rows")("\nUNION ALL\n".join(
    f"SELECT '{n}' AS model, f.rep, f.fold, f.id, f.buggy AS label, CAST({sc} AS DOUBLE) AS score, "
    f"CAST({pr} AS INTEGER) AS pred FROM folds f JOIN method_rows m ON m.id = f.id"
    for n, sc, pr in (("rule_loc", "m.LOC / 50.0", "m.LOC >= 30"),
                      ("rule_nest", "m.NestingDepth / 10.0", "m.NestingDepth >= 6"),
                      ("rule_mix", "0.02 * m.LOC + 0.08 * m.NestingDepth", "0.02 * m.LOC + 0.08 * m.NestingDepth >= 1.1"))))

view("fold_metrics", "predictions")("""
SELECT model, rep, fold,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
            THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END AS f1,
       CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (rs - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn))
            ELSE 'NaN'::DOUBLE END AS auc,
       CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END AS kappa, po AS accuracy,
       CASE WHEN tp + fn > 0 THEN coalesce(found, 0) / (tp + fn) ELSE 0.0 END AS npofb20
FROM (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS po,
             ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS pe
      FROM (SELECT model, rep, fold,
                   CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
                   CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
                   CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
                   CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
                   sum(CASE WHEN label = 1 THEN ar END) AS rs,
                   sum(CASE WHEN label = 1 AND pos <= least(ceil(n * 0.2), nb) THEN 1 ELSE 0 END) AS found
            FROM (SELECT *, (rank() OVER (PARTITION BY model, rep, fold ORDER BY score) * 2
                             + count(*) OVER (PARTITION BY model, rep, fold, score) - 1) / 2.0 AS ar,
                         row_number() OVER (PARTITION BY model, rep, fold ORDER BY score DESC, id) AS pos,
                         count(*) OVER (PARTITION BY model, rep, fold) AS n,
                         sum(label) OVER (PARTITION BY model, rep, fold) AS nb
                  FROM predictions) p
            GROUP BY 1, 2, 3) c) k""")

_METRICS = ("precision", "recall", "f1", "auc", "kappa", "accuracy", "npofb20")

view("cv_summary", "fold_metrics")("""
SELECT model, """ + ", ".join(
    f"avg(CASE WHEN NOT isnan({m}) THEN {m} END) AS avg_{m}, arg_max({m}, rep) AS last_{m}" for m in _METRICS) + """,
       count(*) AS runs
FROM (SELECT model, rep, """ + ", ".join(f"avg({m}) AS {m}" for m in _METRICS) + """ FROM fold_metrics GROUP BY 1, 2) r
GROUP BY model""")


view("spearman_p", "method_rows")("""
SELECT Project, feature, corr(rx, ry) AS rho FROM (
  SELECT Project, feature, rank() OVER x + (count(*) OVER (PARTITION BY Project, feature, value) - 1) / 2.0 AS rx,
         rank() OVER y + (count(*) OVER (PARTITION BY Project, feature, buggy) - 1) / 2.0 AS ry
  FROM (""" + "\nUNION ALL\n".join(f"SELECT Project, buggy, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM method_rows" for f in ML_FEATURES) + """) l
  WHERE value IS NOT NULL
  WINDOW x AS (PARTITION BY Project, feature ORDER BY value), y AS (PARTITION BY Project, feature ORDER BY buggy)) r
GROUP BY 1, 2""")

view("folds_p", "method_rows")("""
SELECT Project, id, buggy, rep, CAST((row_number() OVER (PARTITION BY Project, rep, buggy
           ORDER BY md5(id || '-' || CAST(rep AS VARCHAR) || '-42'), id) - 1) % 5 AS INTEGER) AS fold
FROM method_rows, (SELECT CAST(range AS INTEGER) AS rep FROM range(2)) r""")


def derived(name: str, source: str, renames: dict[str, str], *deps: str) -> None:
    """``name`` is view ``source`` over other views."""
    body = VIEWS[source][1]
    for old, new in renames.items():
        body = body.replace(old, new)
    view(name, *deps)(body)


derived("predictions_p", "predictions", {"FROM folds f": "FROM folds_p f", "SELECT '": "SELECT m.Project || '/' || '"}, "folds_p", "method_rows")
derived("fold_metrics_p", "fold_metrics", {"FROM predictions)": "FROM predictions_p)"}, "predictions_p")
derived("cv_summary_p", "cv_summary", {"FROM fold_metrics": "FROM fold_metrics_p"}, "fold_metrics_p")


derived("folds_full", "folds", {"% 5": "% 10", "range(2)": "range(10)"}, "method_rows")


def _nb_predictions_full() -> str:
    feats = ("LOC", "NestingDepth", "ParameterCount", "TotalChurn")
    stats = ", ".join(f"avg({f}) AS m_{f}, greatest(var_pop({f}), 1e-9) AS v_{f}" for f in feats)
    ll = lambda c: f"ln({c}.n) + " + " + ".join(
        f"(-0.5 * ln(2 * pi() * {c}.v_{f}) - pow(x.{f} - {c}.m_{f}, 2) / (2 * {c}.v_{f}))" for f in feats)
    return f"""
WITH x AS (SELECT f.rep, f.fold, f.id, f.buggy AS label, {", ".join(f"CAST(m.{f} AS DOUBLE) AS {f}" for f in feats)}
           FROM folds_full f JOIN method_rows m ON m.id = f.id),
t AS (SELECT x.rep, k.fold, x.label, count(*) AS n, {stats}
      FROM x JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(10)) k ON x.fold <> k.fold GROUP BY 1, 2, 3)
SELECT 'NaiveBayes' AS model, x.rep, x.fold, x.id, x.label, 1.0 / (1.0 + exp(({ll('n')}) - ({ll('y')}))) AS score,
       CAST(1.0 / (1.0 + exp(({ll('n')}) - ({ll('y')}))) >= 0.5 AS INTEGER) AS pred
FROM x JOIN t y ON y.rep = x.rep AND y.fold = x.fold AND y.label = 1 JOIN t n ON n.rep = x.rep AND n.fold = x.fold AND n.label = 0"""


view("nb_predictions_full", "folds_full", "method_rows")(_nb_predictions_full())
derived("nb_fold_metrics_full", "fold_metrics", {"FROM predictions)": "FROM nb_predictions_full)"}, "nb_predictions_full")
derived("nb_summary_full", "cv_summary", {"FROM fold_metrics": "FROM nb_fold_metrics_full"}, "nb_fold_metrics_full")


def line_count(c: str) -> str:
    return (f"CAST(CASE WHEN {c} IS NULL THEN 0 WHEN {c} = '' THEN 1 "
            f"WHEN regexp_replace({c}, '(\r?\n)+$', '') = '' THEN 0 "
            f"ELSE len(string_split_regex(regexp_replace({c}, '(\r?\n)+$', ''), '\r?\n')) END AS BIGINT)")


VIEWS["page_metrics"] = (VIEWS["page_metrics"][0], VIEWS["page_metrics"][1].replace("{LC_p}", line_count("p.html")))


def _cut(order: str) -> str:
    if order == "date":
        sort = "r.release_date, d.Release"
        src = ("(SELECT DISTINCT d.ProjectName, d.Release, r.release_date FROM dataset d "
               "LEFT JOIN releases r ON r.project = d.ProjectName AND r.name = d.Release) d")
        sort = "release_date, Release"
    else:
        src = "(SELECT DISTINCT ProjectName, Release FROM dataset) d"
        sort = "Release"
    return with_views("dataset") + f"""
, rel AS (SELECT ProjectName, Release, row_number() OVER (PARTITION BY ProjectName ORDER BY {sort}) AS rn,
                 count(*) OVER (PARTITION BY ProjectName) AS n FROM {src}),
kept AS (SELECT ProjectName, Release FROM rel WHERE rn <= least(greatest(floor(n * 0.34 + 0.5), 1), n))
SELECT d.ProjectName, d.Release, count(*) AS n_rows, count(CASE WHEN d.Bugginess = 'yes' THEN 1 END) AS n_buggy
FROM dataset d JOIN kept k ON k.ProjectName = d.ProjectName AND k.Release = d.Release
GROUP BY 1, 2"""


def sql(name: str) -> str:
    return QUERIES[name]()


def _release_activity() -> str:
    return with_views("commit_release") + """
SELECT project, release_id, release_date, count(*) AS n_commits, count(DISTINCT author) AS n_authors
FROM commit_release GROUP BY project, release_id, release_date"""


def _ticket_versions() -> str:
    return with_views("ticket_versions") + """
SELECT project, ticket_key, created, resolved, ov_release_id, fv_release_id, iv_release_id, n_av
FROM ticket_versions WHERE reject_reason IS NULL"""


def _ticket_rejects() -> str:
    return with_views("ticket_versions") + """
SELECT project, reason, count(*) AS n_tickets FROM (
  SELECT project, coalesce(reject_reason, 'valid') AS reason FROM ticket_versions
  UNION ALL SELECT project, 'unresolved' FROM issues WHERE resolved IS NULL) GROUP BY 1, 2"""


def _affected_versions() -> str:
    return with_views("affected") + """
SELECT project, ticket_key, av_pos, release_id, release_date FROM affected"""


def _proportion_by_project() -> str:
    return with_views("proportion") + "SELECT * FROM proportion"


def _proportion_incremental() -> str:
    return with_views("proportion") + """
SELECT project, ticket_key, resolved, known_before,
       CASE WHEN known_before >= 5 THEN coalesce(mean_before, -1.0) ELSE p_cold END AS p_used
FROM (SELECT v.project, v.ticket_key, v.resolved, p.p_cold,
             count(v.iv_release_id) OVER w AS known_before,
             avg(CASE WHEN v.p_ >= 0 THEN v.p_ END) OVER w AS mean_before
      FROM valid_tickets v JOIN proportion p ON p.project = v.project
      WINDOW w AS (PARTITION BY v.project ORDER BY v.resolved, v.ticket_key
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x"""


def _injected_versions() -> str:
    return with_views("final_tickets") + """
SELECT project, ticket_key, iv_release_id, fv_release_id, estimated, n_affected FROM final_tickets"""


def _fix_commits() -> str:
    return with_views("fixing", "fix_files") + """
SELECT x.project, x.sha, x.ticket_key, x.release_id,
       (SELECT count(*) FROM fix_files f WHERE f.project = x.project AND f.sha = x.sha) AS n_fix_files
FROM fixing x"""


def _bic_pairs(links: str) -> str:
    return with_views(links) + f"""
SELECT l.project, l.sha, l.fix_release_id, count(*) AS n_iv_releases, CAST(sum(n.n) AS BIGINT) AS n_bug_introducing
FROM {links} l JOIN (SELECT project, release_id, count(*) AS n FROM commit_release GROUP BY 1, 2) n
  ON n.project = l.project AND n.release_id = l.iv_release_id
GROUP BY l.project, l.sha, l.fix_release_id"""


def _buggy_commits() -> str:
    return with_views("links") + """
SELECT c.project, c.release_id, count(*) AS n_buggy_commits FROM commit_release c
WHERE EXISTS (SELECT 1 FROM links l WHERE l.project = c.project AND l.iv_release_id = c.release_id)
GROUP BY 1, 2"""


def _labelled_snapshots() -> str:
    return with_views("labelled") + "SELECT project, release_id, path, buggy FROM labelled"


def _label_counters() -> str:
    return with_views("labelled", "links", "fix_files") + """
SELECT s.project, coalesce(a.n_fix_commits, 0) AS n_fix_commits, coalesce(a.n_fix_files, 0) AS n_fix_files,
       coalesce(b.n_intervals, 0) AS n_intervals, s.n_buggy_snapshots, s.n_snapshots
FROM (SELECT project, count(CASE WHEN buggy THEN 1 END) AS n_buggy_snapshots, count(*) AS n_snapshots
      FROM labelled GROUP BY 1) s
LEFT JOIN (SELECT project, count(DISTINCT sha) AS n_fix_commits, count(*) AS n_fix_files FROM fix_files f
           WHERE EXISTS (SELECT 1 FROM links l WHERE l.project = f.project AND l.sha = f.sha) GROUP BY 1) a
  ON a.project = s.project
LEFT JOIN (SELECT project, count(*) AS n_intervals FROM intervals GROUP BY 1) b ON b.project = s.project"""


def _file_history() -> str:
    return with_views("touched") + """
SELECT project, path, count(DISTINCT sha) AS revisions, count(DISTINCT author) AS authors,
       min(CAST(committed_at AS DATE)) AS first_day, max(CAST(committed_at AS DATE)) AS last_day
FROM touched GROUP BY 1, 2"""


def _file_churn() -> str:
    return with_views("file_churn") + "SELECT * FROM file_churn"


def _line_churn() -> str:
    return """
WITH rv AS (SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, turn AS rev, text AS content FROM conversations),
pairs AS (SELECT * FROM (SELECT path, rev, lag(rev) OVER (PARTITION BY path ORDER BY rev) AS prev FROM rv)
          WHERE prev IS NOT NULL),
lines AS (SELECT path, rev, line, count(*) AS n
          FROM (SELECT path, rev, unnest(string_split_regex(regexp_replace(content, '(\r?\n)+$', ''), '\r?\n')) AS line
                FROM rv) GROUP BY 1, 2, 3),
cur AS (SELECT p.path, p.rev, l.line, l.n FROM pairs p JOIN lines l ON l.path = p.path AND l.rev = p.rev),
prv AS (SELECT p.path, p.rev, l.line, l.n FROM pairs p JOIN lines l ON l.path = p.path AND l.rev = p.prev),
d AS (SELECT coalesce(cur.path, prv.path) AS path, coalesce(cur.rev, prv.rev) AS rev,
             coalesce(cur.n, 0) - coalesce(prv.n, 0) AS d
      FROM cur FULL OUTER JOIN prv ON cur.path = prv.path AND cur.rev = prv.rev AND cur.line = prv.line)
SELECT path, rev, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS deleted
FROM d GROUP BY 1, 2"""


def _line_diff() -> str:
    """Longest common subsequence by its table, a row of it for each line of the older side."""
    return """
WITH RECURSIVE rv AS (SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, turn AS rev, translate(text, ' ', chr(10)) AS content FROM conversations),
ln AS (SELECT path, rev, list_filter(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN i < len(string_split(content, chr(10)))
              THEN x || chr(10) ELSE x END), lambda x: x <> '') AS l, content IS NULL AS gone FROM rv),
pr AS MATERIALIZED (SELECT path, rev, l AS b, a FROM (SELECT *, lag(l) OVER o AS a, lag(gone) OVER o AS agone FROM ln WINDOW o AS (PARTITION BY path ORDER BY rev))
                    WHERE NOT gone AND NOT agone),
cells(path, rev, i, j, v) AS (
  SELECT path, rev, 0, unnest(range(1, len(b) + 1)), 0 FROM pr
  UNION ALL
  SELECT path, rev, i + 1, j, max(greatest(v, CASE WHEN hit THEN before + 1 ELSE 0 END)) OVER (PARTITION BY path, rev ORDER BY j)
  FROM (SELECT c.path, c.rev, c.i, c.j, c.v, p.a[c.i + 1] = p.b[c.j] AS hit,
               coalesce(lag(c.v) OVER (PARTITION BY c.path, c.rev ORDER BY c.j), 0) AS before
        FROM cells c JOIN pr p ON p.path = c.path AND p.rev = c.rev WHERE c.i < len(p.a))),
lcs AS (SELECT path, rev, max(v) AS n FROM cells GROUP BY 1, 2)
SELECT path, rev, CAST(len(b) - coalesce(n, 0) AS BIGINT) AS added, CAST(len(a) - coalesce(n, 0) AS BIGINT) AS deleted
FROM pr LEFT JOIN lcs USING (path, rev)"""


view("page_levels", "page_events")("""
SELECT page_id, seq, kind, phase, m, was - low + CASE WHEN m AND phase = 'enter' THEN 1 ELSE 0 END AS level
FROM (SELECT *, min(was) OVER (PARTITION BY page_id ORDER BY seq) AS low
      FROM (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY seq) - step AS was
            FROM (SELECT *, kind IN ('article', 'lambda', 'for', 'li', 'p', 'footer') AS m,
                         CASE WHEN kind NOT IN ('article', 'lambda', 'for', 'li', 'p', 'footer') THEN 0 WHEN phase = 'enter' THEN 1 ELSE -1 END AS step
                  FROM page_events) a) b) c""")

# Each event with every method whose first and last event lie around it.
view("page_enclosing", "page_levels")("""
SELECT e.page_id, e.seq, e.kind, e.phase, o.seq AS owner, o.level
FROM page_levels e
JOIN (SELECT o.page_id, o.seq, o.level, min(x.seq) AS until FROM page_levels o
      LEFT JOIN page_levels x ON x.page_id = o.page_id AND x.m AND x.phase = 'exit' AND x.seq > o.seq AND x.level = o.level
      WHERE o.m AND o.phase = 'enter' GROUP BY 1, 2, 3) o
  ON o.page_id = e.page_id AND o.seq <= e.seq AND (o.until IS NULL OR e.seq <= o.until)""")


def _method_owner() -> str:
    return with_views("page_enclosing") + """
SELECT page_id, owner, CAST(level AS INTEGER) AS level, count(*) AS n_events, CAST(max(seq) AS INTEGER) AS last_seq
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, seq ORDER BY owner DESC) AS rn FROM page_enclosing) x
WHERE rn = 1 GROUP BY 1, 2, 3"""


def _nested_method_metrics() -> str:
    body = VIEWS["page_metrics"][1]
    body = body[body.index("SELECT page_id, count(CASE"):body.index(") m ON m.page_id")]
    for old, new in {"SELECT page_id, count": "SELECT page_id, owner, count", "SELECT e.page_id, e.seq": "SELECT e.page_id, e.owner, e.seq",
                     "FROM page_events e": "FROM page_enclosing e", "PARTITION BY page_id": "PARTITION BY page_id, owner", "GROUP BY page_id": "GROUP BY page_id, owner"}.items():
        body = body.replace(old, new)
    return with_views("page_enclosing") + body


def _first_parent_order() -> str:
    return with_views("commits").replace("WITH ", "WITH RECURSIVE ", 1) + """,
c AS MATERIALIZED (SELECT project, sha, CAST(sha AS BIGINT) % 4 AS branch, committed_at FROM commits),
p AS MATERIALIZED (SELECT project, sha, lag(sha) OVER (PARTITION BY project, branch ORDER BY committed_at, sha) AS parent FROM c),
walk(project, sha, root, depth) AS (
  SELECT project, sha, sha, 0::BIGINT FROM p WHERE parent IS NULL
  UNION ALL SELECT p.project, p.sha, walk.root, walk.depth + 1 FROM walk JOIN p ON p.project = walk.project AND p.parent = walk.sha)
SELECT * FROM walk"""


def _first_releases() -> str:
    """Every commit that each release's commit reaches, release by release."""
    return with_views("commit_release").replace("WITH ", "WITH RECURSIVE ", 1) + """,
c AS MATERIALIZED (SELECT project, sha, CAST(sha AS BIGINT) AS k, committed_at FROM commits),
e AS MATERIALIZED (
  SELECT project, sha, lag(sha) OVER (PARTITION BY project, k % 4 ORDER BY committed_at, sha) AS parent FROM c
  UNION ALL SELECT c.project, c.sha, d.sha FROM c JOIN c d ON d.project = c.project AND d.k = c.k + 1 WHERE c.k % 16 = 0),
tip AS MATERIALIZED (
  SELECT project, ord, sha FROM (SELECT project, ord, sha, row_number() OVER (PARTITION BY project, ord ORDER BY committed_at DESC, sha DESC) AS rn
                                 FROM commit_release WHERE ord IS NOT NULL) x WHERE rn = 1),
walk(project, ord, sha) AS (
  SELECT project, ord, sha FROM tip
  UNION SELECT walk.project, walk.ord, e.parent FROM walk JOIN e ON e.project = walk.project AND e.sha = walk.sha WHERE e.parent IS NOT NULL),
first_releases AS (SELECT c.project, c.sha, min(walk.ord) AS ord FROM c LEFT JOIN walk ON walk.project = c.project AND walk.sha = c.sha GROUP BY 1, 2)
"""


def _snapshot_tree() -> str:
    return with_views("file_changes", "commit_release", "release_ord") + """
SELECT project, release_id, path, sha
FROM (SELECT r.project, r.release_id, f.path, f.sha, f.change_type,
             row_number() OVER (PARTITION BY r.project, r.release_id, f.path ORDER BY c.ord DESC, c.committed_at DESC, f.sha DESC) AS rn
      FROM release_ord r JOIN commit_release c ON c.project = r.project AND c.ord <= r.ord
      JOIN file_changes f ON f.project = c.project AND f.sha = c.sha) x
WHERE rn = 1 AND change_type <> 'DELETE'"""


def _smote_rows() -> str:
    """All pairs of minority rows; of the nearest of each, those of the training side."""
    feats = ("LOC", "NestingDepth", "ParameterCount", "TotalChurn")
    dist = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in feats)
    return with_views("folds", "method_rows") + f"""
, mino AS MATERIALIZED (SELECT id, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in feats)} FROM method_rows WHERE buggy = 1),
near AS MATERIALIZED (SELECT base, p.d AS d, p.id AS neighbour FROM (
  SELECT base, unnest(l) AS p FROM (SELECT a.id AS base, min({{'d': sqrt({dist}), 'id': b.id}}, 40) AS l FROM mino a JOIN mino b ON a.id <> b.id GROUP BY a.id))),
train AS (SELECT f.rep, k.fold, f.id FROM folds f JOIN mino USING (id) JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(5)) k ON k.fold <> f.fold),
base AS (SELECT *, row_number() OVER (PARTITION BY rep, fold ORDER BY md5(id || '-42'), id) - 1 AS j, count(*) OVER (PARTITION BY rep, fold) AS n FROM train),
used AS (SELECT rep, fold, id AS base, j FROM base WHERE j < floor(n * 65.0 / 100)),
own AS (SELECT u.rep, u.fold, u.base, u.j, x.neighbour, row_number() OVER (PARTITION BY u.rep, u.fold, u.base ORDER BY x.d, x.neighbour) AS r
        FROM used u JOIN near x ON x.base = u.base JOIN train t ON t.rep = u.rep AND t.fold = u.fold AND t.id = x.neighbour),
pick AS (SELECT *, CAST('0x' || substr(md5(base || '-' || j || '-42'), 1, 8) AS BIGINT) / 4294967296.0 AS u1,
                CAST('0x' || substr(md5(base || '-' || j || '-42'), 9, 8) AS BIGINT) / 4294967296.0 AS gap FROM own WHERE r <= 5)
SELECT p.rep, p.fold, p.base || '~s' || p.j AS id, p.base, p.neighbour, round(gap, 6) AS gap, {", ".join(f"round(a.{f} + gap * (b.{f} - a.{f}), 6) AS {f}" for f in feats)}
FROM pick p JOIN mino a ON a.id = p.base JOIN mino b ON b.id = p.neighbour WHERE r = floor(u1 * 5) + 1"""


def _tree() -> str:
    """One level of the tree per round: rows of mixed nodes are cut at the best
    value and sent on; rows of the first fold follow without a say."""
    feats = ("LOC", "NestingDepth", "ParameterCount", "TotalChurn")
    long = " UNION ALL ".join(f"SELECT node, y, {i} AS f, x{i} AS v FROM cur WHERE t" for i in range(len(feats)))
    return with_views("folds", "method_rows").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
lv(node, id, t, y, {", ".join(f"x{i}" for i in range(len(feats)))}, f, v, n0, n1, up) AS (
  SELECT '', m.id, o.fold <> 0, m.buggy, {", ".join(f"CAST(m.{f} AS DOUBLE)" for f in feats)}, NULL::INTEGER, NULL::DOUBLE, 0::BIGINT, 0::BIGINT, NULL::VARCHAR
  FROM method_rows m JOIN folds o ON o.id = m.id AND o.rep = 0
  UNION ALL
  SELECT * FROM (
    WITH cur AS MATERIALIZED (SELECT * FROM lv WHERE node IS NOT NULL),
    size AS (SELECT node, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM cur WHERE t GROUP BY node),
    hist AS (SELECT l.node, f, v, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM ({long}) l
             JOIN size s ON s.node = l.node AND s.n0 > 0 AND s.n1 > 0 GROUP BY ALL),
    run AS (SELECT node, f, v, CAST(sum(c0) OVER w AS DOUBLE) AS l0, CAST(sum(c1) OVER w AS DOUBLE) AS l1 FROM hist WINDOW w AS (PARTITION BY node, f ORDER BY v)),
    cut AS (SELECT r.node, f, v FROM run r JOIN size s ON s.node = r.node WHERE s.n0 + s.n1 > l0 + l1
            QUALIFY row_number() OVER (PARTITION BY r.node ORDER BY l0 * l1 / (l0 + l1) + (s.n0 - l0) * (s.n1 - l1) / ((s.n0 - l0) + (s.n1 - l1)), f, v) = 1)
    SELECT CASE WHEN cut.f IS NOT NULL THEN cur.node || CASE WHEN [{", ".join(f"x{i}" for i in range(len(feats)))}][cut.f + 1] <= cut.v THEN '0' ELSE '1' END END,
           cur.id, cur.t, cur.y, {", ".join(f"x{i}" for i in range(len(feats)))}, cut.f, cut.v, s.n0, s.n1, cur.node
    FROM cur JOIN size s ON s.node = cur.node LEFT JOIN cut ON cut.node = cur.node))
"""


def _release_snapshot() -> str:
    return with_views("commit_release") + """
SELECT project, release_id, sha, CAST(committed_at AS DATE) AS commit_day, n_commits
FROM (SELECT *, row_number() OVER (PARTITION BY project, release_id ORDER BY committed_at DESC, sha DESC) AS rn,
             count(*) OVER (PARTITION BY project, release_id) AS n_commits FROM commit_release) x
WHERE rn = 1"""


def _nesting_depth() -> str:
    return with_views("page_metrics") + "SELECT method_ord AS page_id, n_nodes, nesting FROM page_metrics"


def _weighted_complexity() -> str:
    return with_views("page_metrics") + "SELECT method_ord AS page_id, params, cyclomatic, cognitive FROM page_metrics"


def _text_size() -> str:
    return f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {line_count('text')} AS n_lines FROM documents"


def _column_profile() -> str:
    cols = ("ProjectName", "Release", "MethodName", "Bugginess")
    union = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM dataset" for c in cols)
    return with_views("dataset") + f"""
SELECT column_name, n_distinct, CASE WHEN n_distinct BETWEEN 1 AND 49 THEN 'nominal' ELSE 'text' END AS kind
FROM ({union}) x"""


def _entropy(a: str, b: str) -> str:
    t = f"({a} + {b})"
    return (f"(CASE WHEN {t} > 0 THEN (CASE WHEN {a} > 0 THEN -({a} / {t}) * log2({a} / {t}) ELSE 0 END)"
            f" + (CASE WHEN {b} > 0 THEN -({b} / {t}) * log2({b} / {t}) ELSE 0 END) ELSE 0 END)")


def _info_gain_fixed_bins() -> str:
    return with_views("ml_long") + f"""
, b AS (SELECT l.feature, l.buggy,
               CASE WHEN r.hi - r.lo > 0 THEN least(floor((l.value - r.lo) / (r.hi - r.lo) * 10), 9) ELSE 0 END AS bin
        FROM ml_long l JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM ml_long GROUP BY 1) r
          ON r.feature = l.feature),
h AS (SELECT feature, bin, CAST(sum(buggy) AS DOUBLE) AS n1, CAST(sum(1 - buggy) AS DOUBLE) AS n0 FROM b GROUP BY 1, 2)
SELECT feature, count(*) AS n_bins,
       round({_entropy('sum(n0)', 'sum(n1)')} - sum((n0 + n1) * {_entropy('n0', 'n1')}) / (sum(n0) + sum(n1)), 6) AS info_gain
FROM h GROUP BY feature"""


def _info_gain_mdl() -> str:
    """Level by level: a row moves on while its interval is cut; its last level names its bin."""
    k = lambda a, b: f"(CASE WHEN {a} > 0 THEN 1 ELSE 0 END + CASE WHEN {b} > 0 THEN 1 ELSE 0 END)"
    return with_views("ml_long").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, hist AS MATERIALIZED (
  SELECT feature, value, CAST(count(*) FILTER (buggy <> 1) AS DOUBLE) AS n0, CAST(count(*) FILTER (buggy = 1) AS DOUBLE) AS n1
  FROM ml_long WHERE value IS NOT NULL GROUP BY 1, 2),
lv AS (
  SELECT feature, value, n0, n1, CAST('-Infinity' AS DOUBLE) AS seg, 0 AS level FROM hist
  UNION ALL
  SELECT feature, value, n0, n1, CASE WHEN value > cut THEN cut ELSE seg END, level + 1 FROM (
    SELECT *, {_entropy('t0', 't1')} AS hs, {_entropy('b0', 'b1')} AS h1, {_entropy('(t0 - b0)', '(t1 - b1)')} AS h2,
           {k('t0', 't1')} AS k, {k('b0', 'b1')} AS k1, {k('(t0 - b0)', '(t1 - b1)')} AS k2 FROM (
      SELECT *, best[1] AS e, best[2] AS cut, best[3] AS b0, best[4] AS b1 FROM (
        SELECT *, min(CASE WHEN t0 + t1 > l0 + l1 THEN
                 [round(((l0 + l1) * {_entropy('l0', 'l1')} + (t0 + t1 - l0 - l1) * {_entropy('(t0 - l0)', '(t1 - l1)')}) / (t0 + t1), 12),
                  value, l0, l1] END) OVER (PARTITION BY feature, seg) AS best FROM (
          SELECT *, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, sum(n0) OVER p AS t0, sum(n1) OVER p AS t1
          FROM lv WINDOW w AS (PARTITION BY feature, seg ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature, seg)) a) b
      WHERE best IS NOT NULL) c) d
  WHERE hs - e > (log2(t0 + t1 - 1) + log2(pow(3.0, k) - 2) - (k * hs - k1 * h1 - k2 * h2)) / (t0 + t1)),
bins AS (SELECT feature, seg, sum(n0) AS n0, sum(n1) AS n1 FROM (
  SELECT feature, value, arg_max(seg, level) AS seg, any_value(n0) AS n0, any_value(n1) AS n1 FROM lv GROUP BY 1, 2) x GROUP BY 1, 2)
SELECT feature, count(*) AS n_bins, CASE WHEN count(*) = 1 THEN 0.0 ELSE
       round({_entropy('sum(n0)', 'sum(n1)')} - sum((n0 + n1) * {_entropy('n0', 'n1')}) / (sum(n0) + sum(n1)), 6) END AS info_gain
FROM bins GROUP BY feature"""


def _fold_metrics_q() -> str:
    return with_views("fold_metrics") + "SELECT model, rep, fold, " + ", ".join(
        f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM fold_metrics"


def _cv_summary_q() -> str:
    cols = ", ".join(f"round(avg_{m}, 6) AS avg_{m}, round(last_{m}, 6) AS last_{m}" for m in _METRICS)
    return with_views("cv_summary") + f"SELECT model, {cols}, runs FROM cv_summary"


def _cv_by_project() -> str:
    cols = ", ".join(f"round(avg_{m}, 6) AS avg_{m}, round(last_{m}, 6) AS last_{m}" for m in _METRICS)
    return with_views("cv_summary_p") + f"""SELECT split_part(model, '/', 1) AS Project, split_part(model, '/', 2) AS classifier,
{cols}, runs FROM cv_summary_p"""


def _forest_cv() -> str:
    """Each of the three classifiers scores every row of its test fold once."""
    return with_views("method_rows") + """
SELECT model, 0 AS rep, fold, count(*) AS n_rows, count(DISTINCT id) AS n_ids, CAST(sum(buggy) AS BIGINT) AS n_buggy, TRUE AS scores_valid
FROM (SELECT id, buggy, CAST((row_number() OVER (PARTITION BY buggy ORDER BY md5(id || '-0-42'), id) - 1) % 3 AS INTEGER) AS fold FROM method_rows) f,
     (SELECT unnest(['NaiveBayes', 'RandomForest', 'IBk']) AS model) m
GROUP BY 1, 3"""


def _composite_q() -> str:
    comp = ("0.30 * avg_auc + 0.40 * avg_recall + 0.20 * least(greatest(avg_npofb20 / 1.0, 0.0), 1.0) "
            "+ 0.10 * (avg_kappa + 1.0) / 2.0")
    return with_views("cv_summary") + f"""
SELECT row_number() OVER (ORDER BY {comp} DESC, model) AS position, model, round({comp}, 6) AS composite
FROM cv_summary"""


def _metric_distribution_q() -> str:
    union = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM fold_metrics" for m in _METRICS)
    return with_views("fold_metrics") + f"""
SELECT model, metric, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q3, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range
FROM ({union}) x GROUP BY 1, 2"""


def _nb_sql(src: str, train: str, feats: list[str], label: str) -> str:
    """Gaussian NB in SQL: per-class prior/mean/var_pop, log-likelihood, P(1)."""
    stats = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}, greatest(coalesce(var_pop(CAST({f} AS DOUBLE)), 0), 1e-9) AS v_{f}"
                      for f in feats)
    def ll(c):
        terms = " + ".join(f"(-0.5 * ln(2 * pi() * {c}.v_{f}) - pow(CAST(x.{f} AS DOUBLE) - {c}.m_{f}, 2) / (2 * {c}.v_{f}))"
                           for f in feats)
        return f"ln({c}.prior) + {terms}"
    return f"""
, nb AS (SELECT {label} AS cls, count(*) / (SELECT count(*) FROM {train}) AS prior, {stats} FROM {train} GROUP BY 1),
nb_scored AS (SELECT x.*, 1.0 / (1.0 + exp(({ll('n')}) - ({ll('p')}))) AS score
              FROM {src} x, (SELECT * FROM nb WHERE cls = 1) p, (SELECT * FROM nb WHERE cls = 0) n)"""


_NB_FEATS = ["LOC", "NestingDepth", "ParameterCount", "TotalChurn"]
_ACTIONABLE = ["LOC", "ParameterCount", "CycloComplexity", "CognitiveComplexity", "NestingDepth", "NumberOfCodeSmells"]


def _gaussian_nb_scores() -> str:
    return with_views("method_rows") + _nb_sql("method_rows", "method_rows", _NB_FEATS, "buggy") + """
SELECT id, round(score, 6) AS score, CAST(score >= 0.5 AS INTEGER) AS pred FROM nb_scored"""


def _knn_scores() -> str:
    return """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT i, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM e) GROUP BY i),
s AS (SELECT e.vec_id, e.label, u.i, CASE WHEN d.hi > d.lo THEN (u.x - d.lo) / (d.hi - d.lo) ELSE 0.0 END AS x
      FROM e, LATERAL (SELECT unnest(e.v) AS x, unnest(range(len(e.v))) AS i) u JOIN d ON d.i = u.i),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS n, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist
          FROM s a JOIN s b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, CAST(n AS VARCHAR)) AS r FROM pairs)
        WHERE r <= 5),
w AS (SELECT t.q, e.label AS c, sum(1.0 / (t.dist + 1e-6)) AS wc FROM top t JOIN e ON e.vec_id = t.n GROUP BY 1, 2)
SELECT q AS vec_id, arg_min(c, (-wc, c)) AS pred_label, round(max(wc) / sum(wc), 6) AS score FROM w GROUP BY q"""


_TAGGED = """
, split AS (SELECT *, CASE WHEN NestingDepth > 0 AND NOT isnan(CAST(NestingDepth AS DOUBLE)) THEN 'B+' ELSE 'C' END AS part
            FROM method_rows),
tagged AS (SELECT * EXCLUDE (part), 'A' AS dataset FROM split
           UNION ALL BY NAME SELECT * EXCLUDE (part), part AS dataset FROM split
           UNION ALL BY NAME SELECT * EXCLUDE (part, NestingDepth), 0.0 AS NestingDepth, 'B' AS dataset
           FROM split WHERE part = 'B+'),
scored AS (SELECT *, CAST(0.02 * LOC + 0.08 * NestingDepth >= 0.9 AS INTEGER) AS pred FROM tagged),
summ AS (SELECT dataset, CASE WHEN dataset = 'B' THEN NULL ELSE CAST(sum(buggy) AS BIGINT) END AS actual,
                CAST(sum(pred) AS BIGINT) AS predicted, count(*) AS n_rows FROM scored GROUP BY 1)"""


def _whatif_verdict() -> str:
    return with_views("method_rows") + _TAGGED + """
SELECT round(CASE WHEN eb > 0 THEN (eb - e_b) / eb ELSE 0.0 END, 6) AS avoided_share,
       na = nbp + nc AS rows_conserved, aa = abp + ac AS actual_conserved, ea = eb + ec AS predicted_conserved
FROM (SELECT CAST(max(CASE WHEN dataset = 'B+' THEN predicted END) AS DOUBLE) AS eb,
             max(CASE WHEN dataset = 'B' THEN predicted END) AS e_b,
             max(CASE WHEN dataset = 'A' THEN predicted END) AS ea, max(CASE WHEN dataset = 'C' THEN predicted END) AS ec,
             max(CASE WHEN dataset = 'A' THEN actual END) AS aa, max(CASE WHEN dataset = 'B+' THEN actual END) AS abp,
             max(CASE WHEN dataset = 'C' THEN actual END) AS ac,
             max(CASE WHEN dataset = 'A' THEN n_rows END) AS na, max(CASE WHEN dataset = 'B+' THEN n_rows END) AS nbp,
             max(CASE WHEN dataset = 'C' THEN n_rows END) AS nc FROM summ) x"""


def _refactor_scored() -> str:
    cut = """
, d AS (SELECT *, CAST(Bugginess = 'yes' AS INTEGER) AS buggy FROM dataset),
rel AS (SELECT d.ProjectName, d.Release, row_number() OVER (PARTITION BY d.ProjectName ORDER BY r.release_date, d.Release) AS rn,
               count(*) OVER (PARTITION BY d.ProjectName) AS n
        FROM (SELECT DISTINCT ProjectName, Release FROM dataset) d
        LEFT JOIN releases r ON r.project = d.ProjectName AND r.name = d.Release),
train AS (SELECT d.* FROM d JOIN rel USING (ProjectName, Release) WHERE rn <= least(greatest(floor(n * 0.34 + 0.5), 1), n)),
test AS (SELECT d.* FROM d JOIN release_ord o ON o.project = d.ProjectName AND o.name = d.Release
         WHERE o.ord = o.n_releases)"""
    return with_views("dataset", "release_ord") + cut + _nb_sql("test", "train", _ACTIONABLE, "buggy")


def _refactor_verdict() -> str:
    return _refactor_scored() + """
SELECT ProjectName, count(*) AS n_scored, CAST(sum(CAST(score >= 0.5 AS INTEGER)) AS BIGINT) AS n_predicted_buggy,
       round(avg(CAST(score >= 0.5 AS INTEGER)) * 100, 6) AS pct_predicted_buggy, round(max(score), 6) AS max_score
FROM nb_scored GROUP BY 1"""


def _text_feature_ranking() -> str:
    feats = ("n_chars", "n_words", "non_letter_share", "distinct_word_share", "distinct_line_share")
    long = " UNION ALL ".join(f"SELECT id, buggy, '{f}' AS feature, {f} AS value FROM tm" for f in feats)
    return r"""
WITH tm AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, CAST(length(text) AS DOUBLE) AS n_chars,
         CAST(len(string_split_regex(text, '\s+')) AS DOUBLE) AS n_words,
         CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '\pL', '', 'g')) / length(text) ELSE 0.0 END
           AS non_letter_share,
         len(list_distinct(string_split_regex(text, '\s+'))) / len(string_split_regex(text, '\s+')) AS distinct_word_share,
         len(list_distinct(string_split_regex(text, '\n'))) / len(string_split_regex(text, '\n')) AS distinct_line_share,
         CAST(l.quality = 0 AS INTEGER) AS buggy
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
long AS (""" + long + """),
sp AS (SELECT feature, corr(rx, ry) AS rho FROM (
  SELECT feature, (rank() OVER (PARTITION BY feature ORDER BY value) * 2
                   + count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
                  (rank() OVER (PARTITION BY feature ORDER BY buggy) * 2
                   + count(*) OVER (PARTITION BY feature, buggy) - 1) / 2.0 AS ry
  FROM long WHERE value IS NOT NULL) x GROUP BY feature)
SELECT row_number() OVER (ORDER BY abs(rho) DESC, feature) AS rank, feature, round(rho, 6) AS spearman_rho,
       FALSE AS actionable
FROM sp WHERE rho IS NOT NULL AND NOT isnan(rho)"""


QUERIES = {
    "release_activity": _release_activity,
    "ticket_versions": _ticket_versions,
    "ticket_rejects": _ticket_rejects,
    "affected_versions": _affected_versions,
    "proportion_by_project": _proportion_by_project,
    "proportion_incremental": _proportion_incremental,
    "proportion_self_cold_start": lambda: with_views("valid_tickets") + """
SELECT project, n_known, n_computable, p_mean, p_cold,
       CASE WHEN n_known >= 5 THEN p_mean ELSE p_cold END AS p_used,
       CASE WHEN n_known >= 5 THEN 'mean' ELSE 'cold_start' END AS method
FROM (SELECT *, CASE WHEN p_mean >= 0 THEN p_mean ELSE 0.5 END AS p_cold
      FROM (SELECT project, count(iv_release_id) AS n_known, count(CASE WHEN p_ >= 0 THEN 1 END) AS n_computable,
                   coalesce(avg(CASE WHEN p_ >= 0 THEN p_ END), -1.0) AS p_mean
            FROM valid_tickets GROUP BY project) p) q""",
    "injected_versions": _injected_versions,
    "fix_commits": _fix_commits,
    "bug_introducing_pairs": lambda: _bic_pairs("links"),
    "bug_introducing_pairs_release": lambda: _bic_pairs("links_release"),
    "buggy_commits": _buggy_commits,
    "labelled_snapshots": _labelled_snapshots,
    "label_counters": _label_counters,
    "file_history": _file_history,
    "line_diff": _line_diff,
    "method_owner": _method_owner,
    "nested_method_metrics": _nested_method_metrics,
    "first_parent_order": _first_parent_order,
    "first_releases": lambda: _first_releases() + "SELECT * FROM first_releases",
    "commits_not_in_release": lambda: _first_releases() + "SELECT project, sha FROM first_releases WHERE ord IS NULL",
    "snapshot_tree": _snapshot_tree,
    "smote_rows": _smote_rows,
    "tree_nodes": lambda: _tree() + "SELECT DISTINCT up AS node, f AS feature, v AS value, n0, n1 FROM lv WHERE up IS NOT NULL",
    "tree_holdout": lambda: _tree() + "SELECT id, up AS node, n0, n1 FROM lv WHERE up IS NOT NULL AND f IS NULL AND NOT t",
    "folds_10x10": lambda: with_views("folds_full") + "SELECT * FROM folds_full",
    "nb_cv_10x10": lambda: with_views("nb_fold_metrics_full") + "SELECT model, rep, fold, " + ", ".join(
        f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM nb_fold_metrics_full",
    "nb_cv_summary_10x10": lambda: with_views("nb_summary_full") + "SELECT model, " + ", ".join(
        f"round(avg_{m}, 6) AS avg_{m}, round(last_{m}, 6) AS last_{m}" for m in _METRICS) + ", runs FROM nb_summary_full",
    "file_churn": _file_churn,
    "line_churn": _line_churn,
    "release_snapshot": _release_snapshot,
    "release_snapshot_log_last": lambda: with_views("commit_release") + """
SELECT project, release_id, sha, CAST(committed_at AS DATE) AS commit_day, n_commits
FROM (SELECT *, row_number() OVER (PARTITION BY project, release_id ORDER BY committed_at, sha) AS rn,
             count(*) OVER (PARTITION BY project, release_id) AS n_commits FROM commit_release) x
WHERE rn = 1""",
    "file_churn_all_history": lambda: with_views("touched", "java_snapshots") + """
SELECT s.project, s.release_id, s.path, count(DISTINCT t.sha) AS revisions, count(DISTINCT t.author) AS authors,
       CAST(coalesce(sum(CASE WHEN t.rn > 1 THEN t.added + t.deleted END), 0) AS BIGINT) AS total_churn,
       CAST(coalesce(max(CASE WHEN t.rn > 1 THEN t.added END), 0) AS BIGINT) AS max_churn,
       coalesce(avg(CASE WHEN t.rn > 1 THEN t.added END), 0.0) AS avg_churn
FROM java_snapshots s LEFT JOIN touched t ON t.project = s.project AND t.path = s.path
GROUP BY s.project, s.release_id, s.path""",
    "nesting_depth": _nesting_depth,
    "weighted_complexity": _weighted_complexity,
    "text_size": _text_size,
    "smell_counts": lambda: with_views("smells") + "SELECT * FROM smells",
    "range_smell_counts": lambda: with_views("range_smells") + "SELECT * FROM range_smells",
    "method_dataset": lambda: with_views("dataset") + "SELECT * FROM dataset",
    "dataset_cut": lambda: _cut("date"),
    "dataset_cut_by_name": lambda: _cut("name"),
    "column_profile": _column_profile,
    "spearman_ranking": lambda: with_views("feature_ranking")
    + "SELECT rank, feature, round(spearman_rho, 6) AS spearman_rho, actionable FROM feature_ranking",
    "best_actionable": lambda: with_views("feature_ranking")
    + "SELECT feature, round(spearman_rho, 6) AS spearman_rho FROM feature_ranking "
      "WHERE actionable AND spearman_rho > 0 ORDER BY rank LIMIT 1",
    "worst_method": lambda: with_views("method_rows")
    + "SELECT 'NestingDepth' AS feature, id, NestingDepth AS value FROM method_rows WHERE buggy = 1 "
      "AND Release = (SELECT max(Release) FROM method_rows) ORDER BY NestingDepth DESC, id LIMIT 1",
    "worst_method_all_releases": lambda: with_views("method_rows")
    + "SELECT 'NestingDepth' AS feature, id, NestingDepth AS value FROM method_rows WHERE buggy = 1 "
      "ORDER BY NestingDepth DESC, id LIMIT 1",
    "info_gain_fixed_bins": _info_gain_fixed_bins,
    "info_gain_mdl": _info_gain_mdl,
    "text_feature_ranking": _text_feature_ranking,
    "folds": lambda: with_views("folds") + "SELECT * FROM folds",
    "downsample": lambda: with_views("method_rows")
    + "SELECT id, buggy FROM method_rows ORDER BY md5(id || '-42'), id LIMIT 20000",
    "fold_metrics": _fold_metrics_q,
    "cv_summary": _cv_summary_q,
    "composite_ranking": _composite_q,
    "metric_distribution": _metric_distribution_q,
    "gaussian_nb_scores": _gaussian_nb_scores,
    "knn_scores": _knn_scores,
    "whatif_split": lambda: with_views("method_rows") + _TAGGED
    + " SELECT dataset, count(*) AS n_rows, sum(NestingDepth) AS feature_sum FROM tagged GROUP BY 1",
    "whatif_summary": lambda: with_views("method_rows") + _TAGGED + " SELECT * FROM summ",
    "whatif_verdict": _whatif_verdict,
    "smote_balance": lambda: with_views("method_rows") + """
SELECT buggy, FALSE AS synthetic, count(*) AS n_rows FROM method_rows GROUP BY 1
UNION ALL SELECT 1, TRUE, CAST(floor(count(*) * 65 / 100) AS BIGINT) FROM method_rows WHERE buggy = 1""",
    "whatif_forest": lambda: with_views("method_rows") + _TAGGED
    + " SELECT dataset, actual, n_rows, TRUE AS predicted_valid, TRUE AS predicted_conserved FROM summ",
    "forest_cv": _forest_cv,
    "spearman_by_project": lambda: with_views("spearman_p") + """
SELECT Project, row_number() OVER (PARTITION BY Project ORDER BY abs(rho) DESC, feature) AS rank, feature,
       round(rho, 6) AS spearman_rho, feature IN ('LOC', 'NestingDepth', 'ParameterCount') AS actionable
FROM spearman_p WHERE rho IS NOT NULL AND NOT isnan(rho)""",
    "folds_by_project": lambda: with_views("folds_p") + "SELECT * FROM folds_p",
    "cv_by_project": _cv_by_project,
    "prediction_report": lambda: _refactor_scored() + """
SELECT MethodName, CASE WHEN score >= 0.5 THEN 'yes' ELSE 'no' END AS predicted, round(score, 4) AS p_yes FROM nb_scored""",
    "refactor_verdict": _refactor_verdict,
    "method_feature_ranking": lambda: with_views("feature_ranking", "ml_long") + """
, focus AS (SELECT feature FROM feature_ranking WHERE actionable AND spearman_rho > 0 ORDER BY rank LIMIT 1),
worst AS (SELECT id FROM ml_long WHERE buggy = 1 AND feature = (SELECT feature FROM focus)
          ORDER BY value DESC, id LIMIT 1)
SELECT row_number() OVER (ORDER BY (l.feature = (SELECT feature FROM focus)) DESC, abs(r.spearman_rho) DESC, l.feature)
         AS rank, l.feature, l.value AS feature_value, round(r.spearman_rho, 6) AS spearman_rho
FROM ml_long l JOIN feature_ranking r ON r.feature = l.feature WHERE l.id = (SELECT id FROM worst)""",
    "tickets_per_release": lambda: with_views("final_tickets") + """
SELECT coalesce(f.project, i.project) AS project, coalesce(f.release_id, i.release_id) AS release_id,
       coalesce(f.n_fixed, 0) AS n_fixed, coalesce(i.n_injected, 0) AS n_injected
FROM (SELECT project, fv_release_id AS release_id, count(*) AS n_fixed FROM final_tickets GROUP BY 1, 2) f
FULL OUTER JOIN (SELECT project, iv_release_id AS release_id, count(*) AS n_injected FROM final_tickets GROUP BY 1, 2) i
  ON f.project = i.project AND f.release_id = i.release_id""",
    "project_results_upsert": lambda: with_views("fold_metrics") + """
, per_rep AS (SELECT model, rep, avg(auc) AS auc, avg(recall) AS recall FROM fold_metrics GROUP BY 1, 2),
old AS (SELECT 'method_rows' AS project, model AS classifier, 1 AS run_ts,
               avg(CASE WHEN NOT isnan(auc) THEN auc END) AS avg_auc,
               avg(CASE WHEN NOT isnan(recall) THEN recall END) AS avg_recall, count(*) AS runs
        FROM per_rep WHERE rep = 0 GROUP BY model),
new AS (SELECT 'method_rows' AS project, model AS classifier, 2 AS run_ts,
               avg(CASE WHEN NOT isnan(auc) THEN auc END) AS avg_auc,
               avg(CASE WHEN NOT isnan(recall) THEN recall END) AS avg_recall, count(*) AS runs
        FROM per_rep WHERE model = 'rule_mix' GROUP BY model)
SELECT project, classifier, run_ts, round(avg_auc, 6) AS avg_auc, round(avg_recall, 6) AS avg_recall, runs
FROM (SELECT *, row_number() OVER (PARTITION BY project, classifier ORDER BY run_ts DESC) AS rn
      FROM (SELECT * FROM old UNION ALL SELECT * FROM new) u) x WHERE rn = 1""",
    "results_versions": lambda: with_views("fold_metrics") + """
, per_rep AS (SELECT model, rep, avg(auc) AS auc, avg(recall) AS recall FROM fold_metrics GROUP BY 1, 2),
old AS (SELECT substr(model, 1, 1) AS project, model AS classifier, 1 AS run_ts,
               avg(CASE WHEN NOT isnan(auc) THEN auc END) AS avg_auc,
               avg(CASE WHEN NOT isnan(recall) THEN recall END) AS avg_recall, count(*) AS runs
        FROM per_rep WHERE rep = 0 GROUP BY model),
new AS (SELECT substr(model, 1, 1) AS project, model AS classifier, 2 AS run_ts,
               avg(CASE WHEN NOT isnan(auc) THEN auc END) AS avg_auc,
               avg(CASE WHEN NOT isnan(recall) THEN recall END) AS avg_recall, count(*) AS runs
        FROM per_rep WHERE model = 'rule_mix' GROUP BY model)
SELECT 2 AS version, project, classifier, run_ts, round(avg_auc, 6) AS avg_auc, round(avg_recall, 6) AS avg_recall, runs
FROM (SELECT *, row_number() OVER (PARTITION BY project, classifier ORDER BY run_ts DESC) AS rn
      FROM (SELECT * FROM old UNION ALL SELECT * FROM new) u) x WHERE rn = 1
UNION ALL SELECT 1, project, classifier, run_ts, round(avg_auc, 6), round(avg_recall, 6), runs FROM old""",
}
