"""DuckDB SQL fragments for the oracle statements.

Each helper returns CTE text written independently of the Spark code (plain
nested-loop style where that is simplest), so the oracle is a second,
straightforward formulation of the same semantics.
"""

from __future__ import annotations

# Python's whitespace set and digits, in RE2 syntax.
WS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def lit(s: str) -> str:
    out = "'" + s.replace("'", "''") + "'"
    return out.replace("\n", "' || chr(10) || '")


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def pysplit(expr: str) -> str:
    s = strip(expr)
    return f"CASE WHEN length({s}) = 0 THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, {lit(WS + '+')}) END"


def window(text: str, pos: str, length: str, n: str, before: int, after: int) -> str:
    st = f"greatest({pos} - {before}, 0)"
    en = f"least({n}, {pos} + {length} + {after})"
    return f"substring({text}, {st} + 1, greatest({en} - {st}, 0))"


def occurrences(terms: str, keys: list[str], jobs: str = "jobs") -> str:
    """Non-overlapping occurrences: SELECT body over a terms relation with
    job_id, keys, term.  Returns job_id, keys, term, L, occ, pos."""
    k = ", ".join(keys)
    return f"""
    (WITH p0 AS (SELECT t.job_id, {', '.join('t.' + c for c in keys)}, t.term, length(t.term) AS L,
                        string_split(j.lt, lower(t.term)) AS parts
                 FROM {terms} t JOIN {jobs} j USING (job_id) WHERE length(t.term) > 0),
          p1 AS (SELECT job_id, {k}, term, L, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM p0)
     SELECT job_id, {k}, term, L, i - 1 AS occ,
            CAST(sum(length(parts[i])) OVER (PARTITION BY job_id, {k} ORDER BY i ROWS UNBOUNDED PRECEDING)
                 + (i - 1) * L AS BIGINT) AS pos
     FROM p1)"""


def drop_contained(cands: str) -> str:
    """T6 over a relation (job_id, src, k1, k2, k3, target) -> (job_id, t_ord, target)."""
    return f"""
    (WITH r AS (SELECT job_id, target, src, k1, k2, k3,
                       row_number() OVER (PARTITION BY job_id, target ORDER BY src, k1, k2, k3) AS rn
                FROM {cands}),
          l AS (SELECT job_id, list(target ORDER BY src, k1, k2, k3) AS l FROM r WHERE rn = 1 GROUP BY job_id),
          k AS (SELECT job_id, list_reduce(l, lambda acc, x:
                    CASE WHEN len(list_filter(acc, lambda y: length(y) <> length(x)
                                             AND (contains(y, x) OR contains(x, y)))) > 0
                         THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS kl FROM l),
          u AS (SELECT job_id, kl, unnest(generate_series(1, len(kl))) AS i FROM k)
     SELECT job_id, i - 1 AS t_ord, kl[i] AS target FROM u)"""


def quoted_spans(jobs: str = "jobs") -> str:
    dq = lit(r'"([^"]*)"')
    sq = lit(r"'([^']*)'")
    return f"""
    (WITH s0 AS (SELECT job_id, list_concat(regexp_extract_all(instruction, {dq}, 1),
                                             regexp_extract_all(instruction, {sq}, 1)) AS l FROM {jobs}),
          s1 AS (SELECT job_id, l, unnest(generate_series(1, len(l))) AS i FROM s0)
     SELECT job_id, i - 1 AS k1, l[i] AS term FROM s1 WHERE length(l[i]) > 3)"""


def fixed_chunks(size: int, overlap: int, jobs: str = "jobs") -> str:
    step = size - overlap
    return f"""
    (WITH c0 AS (SELECT job_id, doc_id, text, n,
                        unnest(generate_series(0, greatest(n - {overlap} - 1, 0), {step})) AS start FROM {jobs})
     SELECT job_id, doc_id, CAST(start // {step} AS BIGINT) AS chunk_no, start, least(start + {size}, n) AS "end",
            substring(text, start + 1, least(start + {size}, n) - start) AS ctext FROM c0)"""


def target_points(chunks: str, targets: str) -> str:
    """P1 as a plain nested comparison: (job_id, chunk_no, p) per chunk/target pair."""
    lc = "lower(c.ctext)"
    lt = "lower(t.target)"
    pos = f"(strpos({lc}, {lt}) - 1)"
    clen = "length(c.ctext)"
    h = f"(length({lt}) // 2)"
    return f"""
    (SELECT c.job_id, c.chunk_no,
            (CASE WHEN contains({lc}, {lt}) THEN 5 + CASE WHEN {pos} < {clen} // 3 THEN 2
                                                      WHEN {pos} < ({clen} * 2) // 3 THEN 1 ELSE 0 END
                  WHEN length({lt}) > 10 THEN 2 * CAST(contains({lc}, substring({lt}, 1, {h})) AS INT)
                                             + 2 * CAST(contains({lc}, substring({lt}, {h} + 1)) AS INT)
                  ELSE 0 END) * t.n AS p
     FROM {chunks} c JOIN {targets} t USING (job_id))"""


DIGIT = r"\p{Nd}"
PART_SEPARATOR = rf"\n|{DIGIT}+\.|{WS}*-{WS}*"
ANY_QUOTED = r"""['"]([^'"]+)['"]"""


def _roles_suffixes():
    from docrevise.functions import constants as K
    return "|".join(K.COMPANY_ROLES), "|".join(K.COMPANY_SUFFIXES)


def company_patterns() -> list[str]:
    roles, suf = _roles_suffixes()
    return [
        rf"""(?:{roles}){WS}+Name.*?['"]([^'"]+)['"]""",
        rf"""[Cc]hange{WS}+(?:the{WS}+)?([^'"].*?(?:{suf}))[^'"].*?from""",
        rf"""[Uu]pdate{WS}+(?:the{WS}+)?([^'"].*?(?:{suf}))[^'"].*?from""",
    ]


def list_lit(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def parts(jobs: str = "jobs") -> str:
    """(job_id, part_ord, part)."""
    return f"""
    (WITH a AS (SELECT job_id, regexp_split_to_array(instruction, {lit(PART_SEPARATOR)}) AS l FROM {jobs}),
          b AS (SELECT job_id, l, unnest(generate_series(1, len(l))) AS i FROM a),
          c AS (SELECT job_id, i - 1 AS part_ord, {strip('l[i]')} AS part FROM b)
     SELECT * FROM c WHERE length(part) >= 5)"""


def action_phrases(parts_rel: str, verbs) -> str:
    """(job_id, part_ord, verb_ord, verb, phrase, search)."""
    phrase = strip("substring(part, vpos + length(verb) + 1)")
    return f"""
    (WITH v AS (SELECT p.job_id, p.part_ord, p.part, i - 1 AS verb_ord, ({list_lit(verbs)})[i] AS verb
                FROM {parts_rel} p, (SELECT unnest(generate_series(1, {len(verbs)})) AS i) g),
          w AS (SELECT *, strpos(lower(part), verb) - 1 AS vpos FROM v),
          x AS (SELECT *, {phrase} AS phrase FROM w
                WHERE vpos >= 0 AND vpos + length(verb) + 1 < length(part)),
          y AS (SELECT *, array_to_string(({pysplit('phrase')})[1:3], ' ') AS search FROM x WHERE length(phrase) > 3)
     SELECT job_id, part_ord, verb_ord, verb, phrase, search FROM y WHERE length(search) > 3)"""


def field_mentions(fields, jobs: str = "jobs") -> str:
    """I4: (job_id, field_ord, field)."""
    return f"""
    (SELECT job_id, i - 1 AS field_ord, ({list_lit(fields)})[i] AS field
     FROM {jobs}, (SELECT unnest(generate_series(1, {len(fields)})) AS i) g
     WHERE contains(lower(instruction), ({list_lit(fields)})[i]))"""


def _explode(rel_list_sql: str, ord_name: str, val_name: str) -> str:
    return f"""
    (WITH a AS ({rel_list_sql}),
          b AS (SELECT job_id, l, unnest(generate_series(1, len(l))) AS i FROM a)
     SELECT job_id, i - 1 AS {ord_name}, l[i] AS {val_name} FROM b)"""


def quoted_entity_list(instr: str = "instruction") -> str:
    return f"list_filter(regexp_extract_all({instr}, {lit(ANY_QUOTED)}, 1), lambda s: length(s) > 3)"


def company_entity_list(instr: str = "instruction") -> str:
    lists = [f"list_transform(regexp_extract_all({instr}, {lit(p)}, 1), lambda s: {strip('s')})"
             for p in company_patterns()]
    return f"list_filter(list_concat({', '.join(lists)}), lambda s: length(s) > 3)"


def key_entities(jobs: str = "jobs") -> str:
    """(job_id, ent_ord, entity), first-occurrence order."""
    return f"""
    (WITH a AS (SELECT job_id, list_concat({quoted_entity_list()}, {company_entity_list()}) AS l FROM {jobs}),
          b AS (SELECT job_id, l, unnest(generate_series(1, len(l))) AS i FROM a),
          c AS (SELECT job_id, i, l[i] AS entity,
                       row_number() OVER (PARTITION BY job_id, l[i] ORDER BY i) AS rn FROM b),
          d AS (SELECT job_id, entity, row_number() OVER (PARTITION BY job_id ORDER BY i) - 1 AS ent_ord
                FROM c WHERE rn = 1)
     SELECT job_id, ent_ord, entity FROM d)"""


REPLACEMENT_PAIR = rf"""(?:from{WS}+)?['"]([^'"]+)['"]{WS}+to{WS}+['"]([^'"]+)['"]"""


def quoted_windows(jobs: str = "jobs") -> str:
    return f"""
    (WITH s AS {quoted_spans(jobs)}, o AS {occurrences('s', ['k1'], jobs)}
     SELECT o.job_id, 1 AS src, o.k1, 0 AS k2, o.occ AS k3,
            {window('j.text', 'o.pos', 'o.L', 'j.n', 100, 200)} AS target
     FROM o JOIN {jobs} j USING (job_id))"""


def action_windows(verbs, jobs: str = "jobs") -> str:
    return f"""
    (WITH p AS {parts(jobs)}, a AS {action_phrases('p', verbs)},
          h AS (SELECT a.job_id, a.part_ord, a.verb_ord, a.search, strpos(j.lt, lower(a.search)) - 1 AS hit,
                       j.text, j.n FROM a JOIN {jobs} j USING (job_id))
     SELECT job_id, 2 AS src, part_ord AS k1, verb_ord AS k2, 0 AS k3,
            {window('text', 'hit', 'length(search)', 'n', 100, 200)} AS target
     FROM h WHERE hit >= 0)"""


def field_windows(fields, jobs: str = "jobs") -> str:
    return f"""
    (WITH f AS (SELECT job_id, field_ord AS k1, field AS term FROM {field_mentions(fields, jobs)}),
          o AS {occurrences('f', ['k1'], jobs)}
     SELECT o.job_id, 3 AS src, o.k1, 0 AS k2, o.occ AS k3,
            {window('j.text', 'o.pos', 'o.L', 'j.n', 50, 200)} AS target
     FROM o JOIN {jobs} j USING (job_id))"""


def candidates(fields, verbs, jobs: str = "jobs") -> str:
    return f"""
    (SELECT * FROM {quoted_windows(jobs)} UNION ALL SELECT * FROM {action_windows(verbs, jobs)}
     UNION ALL SELECT * FROM {field_windows(fields, jobs)})"""


def presence(jobs: str = "jobs") -> str:
    return f"""
    (SELECT e.job_id, e.ent_ord, e.entity, contains(j.lt, lower(e.entity)) AS found
     FROM {key_entities(jobs)} e JOIN {jobs} j USING (job_id))"""


def paragraphs(sep: str, pres: str, jobs: str = "jobs") -> str:
    rs = lit(sep[::-1])
    sp = lit(sep)
    return f"""
    (WITH f AS (SELECT job_id, ent_ord AS k1, entity AS term FROM {pres} WHERE found),
          o AS {occurrences('f', ['k1'], jobs)},
          b AS (SELECT o.job_id, o.k1, o.occ, o.pos, j.text, j.n,
                       strpos(reverse(substring(j.text, 1, o.pos)), {rs}) AS r,
                       strpos(substring(j.text, o.pos + 1), {sp}) AS r2
                FROM o JOIN {jobs} j USING (job_id)),
          c AS (SELECT *, CASE WHEN r > 0 THEN pos - r + 1 ELSE 0 END AS ps,
                          CASE WHEN r2 > 0 THEN pos + r2 - 1 ELSE n END AS pe FROM b)
     SELECT job_id, 4 AS src, k1, 0 AS k2, occ AS k3, ps AS ws, pe AS we, substring(text, ps + 1, pe - ps) AS target FROM c)"""


def partial_windows(pres: str, jobs: str = "jobs") -> str:
    words = pysplit("entity")
    return f"""
    (WITH nf AS (SELECT job_id FROM {pres} GROUP BY job_id HAVING NOT bool_or(found)),
          e AS (SELECT p.job_id, p.ent_ord, {words} AS w FROM {pres} p WHERE p.job_id IN (SELECT job_id FROM nf)),
          b AS (SELECT job_id, ent_ord, w, unnest(generate_series(1, len(w) - 1)) AS i FROM e),
          c AS (SELECT job_id, ent_ord, i - 1 AS b_ord, w[i] || ' ' || w[i + 1] AS partial FROM b),
          h AS (SELECT c.*, strpos(j.lt, lower(c.partial)) - 1 AS hit, j.text, j.n
                FROM c JOIN {jobs} j USING (job_id) WHERE length(c.partial) >= 5)
     SELECT job_id, 5 AS src, ent_ord AS k1, b_ord AS k2, 0 AS k3,
            {window('text', 'hit', 'length(partial)', 'n', 100, 100)} AS target FROM h WHERE hit >= 0)"""


def sections(fields, verbs, sep: str, jobs: str = "jobs") -> str:
    """T10 body: (job_id, target, n)."""
    return f"""
    (WITH pr AS {presence(jobs)},
          k AS {drop_contained(candidates(fields, verbs, jobs))},
          a AS (SELECT job_id, target FROM k
                UNION ALL SELECT job_id, target FROM {paragraphs(sep, 'pr', jobs)}
                UNION ALL SELECT job_id, target FROM {partial_windows('pr', jobs)})
     SELECT job_id, target, count(*) AS n FROM a GROUP BY ALL)"""


def html_escape(expr: str) -> str:
    out = f"replace({expr}, '&', '&amp;')"
    out = f"replace({out}, '<', '&lt;')"
    out = f"replace({out}, '>', '&gt;')"
    out = f"replace({out}, '\"', '&quot;')"
    return f"replace({out}, '''', '&#x27;')"


def text_page(expr: str) -> str:
    return f"('<!DOCTYPE html><html><body><pre>' || {html_escape(expr)} || '</pre></body></html>')"


def marker_score(text_expr: str, markers) -> str:
    return f"CAST(len(list_filter({list_lit(markers)}, lambda m: contains(lower({text_expr}), m))) AS BIGINT)"


def scored_chunks(size: int, overlap: int, fields, verbs, sep: str, markers, jobs: str = "jobs") -> str:
    """(job_id, doc_id, chunk_no, n, target_score, marker_score, score) for fixed chunks."""
    return f"""
    (WITH c AS {fixed_chunks(size, overlap, jobs)},
          t AS {sections(fields, verbs, sep, jobs)},
          p AS {target_points('c', 't')},
          s AS (SELECT job_id, chunk_no, sum(p) AS ts FROM p GROUP BY ALL)
     SELECT c.job_id, c.doc_id, c.chunk_no, j.n, CAST(coalesce(s.ts, 0) AS BIGINT) AS target_score,
            {marker_score('c.ctext', markers)} AS marker_score,
            CAST(coalesce(s.ts, 0) AS BIGINT) + {marker_score('c.ctext', markers)} AS score,
            (SELECT count(*) FROM t WHERE t.job_id = c.job_id) AS n_targets
     FROM c LEFT JOIN s USING (job_id, chunk_no) JOIN {jobs} j USING (job_id))"""


def error_class(err: str = "error") -> str:
    from docrevise.functions import constants as K
    def any_of(words):
        return "(" + " OR ".join(f"contains({err}, {lit(w)})" for w in words) + ")"
    cred = f"({any_of(K.CREDENTIAL_ERRORS)} OR contains(lower({err}), {lit(K.CREDENTIAL_PHRASE_LOWER)}))"
    return (f"CASE WHEN {err} IS NULL THEN NULL WHEN {cred} THEN 'credentials' "
            f"WHEN {any_of(K.THROTTLE_ERRORS)} THEN 'throttled' "
            f"WHEN {any_of(K.UNAVAILABLE_ERRORS)} THEN 'unavailable' ELSE 'other' END")


def _has(body: str, key: str) -> str:
    return f"coalesce(list_contains(json_keys({body}), {lit(key)}), false)"


def response_text(body: str = "body", rule: str = "hosted", family: str = "family") -> str:
    out0 = f"coalesce(json_extract_string({body}, '$.outputs[0].text'), '')"
    gen = f"coalesce(json_extract_string({body}, '$.generation'), '')"
    n = f"coalesce(json_array_length({body}, '$.outputs'), 0)"
    if rule == "hosted":
        return (f"CASE WHEN {_has(body, 'outputs')} AND {n} > 0 THEN {out0} "
                f"WHEN {_has(body, 'generation')} THEN {gen} ELSE '' END")
    return (f"CASE WHEN {family} THEN coalesce(json_extract_string({body}, '$.content[0].text'), '') "
            f"WHEN {_has(body, 'generation')} THEN {gen} WHEN {_has(body, 'outputs')} THEN {out0} "
            f"WHEN {_has(body, 'text')} THEN coalesce(json_extract_string({body}, '$.text'), '') ELSE {body} END")


def pairs_list(instr: str = "instruction") -> str:
    o = f"regexp_extract_all({instr}, {lit(REPLACEMENT_PAIR)}, 1)"
    w = f"regexp_extract_all({instr}, {lit(REPLACEMENT_PAIR)}, 2)"
    return f"list_transform(generate_series(1, len({o})), lambda i: {{'old': ({o})[i], 'new': ({w})[i]}})"


def literal_revise(text: str, pairs: str) -> str:
    return f"list_reduce({pairs}, lambda t, p: replace(t, p.old, p.new), {text})"
