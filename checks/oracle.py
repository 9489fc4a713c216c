"""The SQL form of each query, as DuckDB runs it on the same tables.

Statements are put together from named common table expressions; ``_sql`` adds those a
statement needs, in order.
"""

from __future__ import annotations

import re

from casewise.config import ASCII_PUNCTUATION, MISSING_LABEL, NA_TOKENS, REQUIRED_COLUMNS, STOPWORDS
from casewise.functions.labels import HISTORY_HIGH_TERMS, REFINER_HIGH_TERMS
from casewise.functions.labels import MEDIUM_TERMS as DEFAULT_MEDIUM_TERMS
from casewise.operators import evaluate, refine, routing
from checks.data import DETAIL_KEYWORDS, HIGH_TERMS, LANGUAGE_WORDS, MEDIUM_TERMS

SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(_quote(word) for word in words)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def blank(x: str) -> str:
    return f"coalesce({x}, '')"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def lines(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {_quote(TOKEN)})"


def lowered(x: str) -> str:
    return f"list_transform({x}, lambda t: lower(t))"


def bare(x: str) -> str:
    return (
        f"list_filter(list_transform({x}, lambda t: translate(t, {_quote(ASCII_PUNCTUATION)}, '')), "
        "lambda t: t <> '')"
    )


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE}]+'))"


def rounded(x: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def short(x: str, limit: int) -> str:
    line = clean(x)
    return (
        f"CASE WHEN {line} = '' THEN '-' WHEN length({line}) <= {limit} THEN {line} "
        f"ELSE rtrim(substring({line}, 1, {limit})) || '...' END"
    )


def joined(x: str, separator: str = " ") -> str:
    return f"array_to_string({x}, {_quote(separator)})"


_BEST_LANGUAGE = "CASE {cases} END".format(
    cases=" ".join(
        f"WHEN h_{lang} = greatest({', '.join('h_' + other for other in sorted(LANGUAGE_WORDS))}) THEN '{lang}'"
        for lang in sorted(LANGUAGE_WORDS)
    )
)
_HITS = ", ".join(
    f"len(list_filter(tokens, lambda t: t IN ({_list(LANGUAGE_WORDS[lang])}))) AS h_{lang}"
    for lang in sorted(LANGUAGE_WORDS)
)
_ALL_HITS = " + ".join(f"h_{lang}" for lang in sorted(LANGUAGE_WORDS))
_TOP_HITS = f"greatest({', '.join('h_' + lang for lang in sorted(LANGUAGE_WORDS))})"

VECTOR_TOKENS = f"regexp_extract_all(strip_accents(lower(processed)), '[{WORD}]{{2,}}')"
NGRAMS = "list_concat(vt, list_transform(range(1, len(vt)), lambda i: vt[i] || ' ' || vt[i + 1]))"

def _contains(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {_quote(term)})" for term in terms) + ")"


def _priority(x: str, high, medium) -> str:
    return f"CASE WHEN {_contains(x, high)} THEN 'alta' WHEN {_contains(x, medium)} THEN 'media' ELSE 'baixa' END"


_MENTIONED = " OR ".join(
    f"(lower(v) = {_quote(name)} AND {_contains('lower(refiner_text)', words)})"
    for name, words in DETAIL_KEYWORDS.items()
)
_FIRST_CLASS = f"list_filter(valid_classes, lambda v: {_MENTIONED})[1]"
_REFINED_PRIORITY = _priority("lower(refiner_text)", REFINER_HIGH_TERMS, DEFAULT_MEDIUM_TERMS)
_AMBIGUOUS = (
    "(len(list_filter(valid_classes, lambda v: contains(lower(refiner_text), lower(v)))) > 1 "
    "OR contains(lower(refiner_text), 'ou'))"
)
_RESPONSE_BODY = """CASE length(texto) % 8
    WHEN 0 THEN '{"detailed_class": "' || valid_classes[1] || '", "ambiguous_case": "false"}'
    WHEN 1 THEN '{"detailed_class": " ' || valid_classes[-1] || ' ", "justification": "' || macro
                || '", "priority": "alta", "ambiguous_case": false}'
    WHEN 2 THEN 'resposta: ' || valid_classes[1]
    WHEN 3 THEN '{"detailed_class": "' || macro || '", "priority": "media"}'
    WHEN 6 THEN ''
    WHEN 7 THEN '{"detailed_class": "' || valid_classes[1] || '", "justification": null, "ambiguous_case": 2}'
    END"""
_RESPONSE_ERROR = "CASE length(texto) % 8 WHEN 4 THEN 'timeout' WHEN 5 THEN 'authentication' END"


def _FIELD(name: str) -> str:
    # json_valid guards each access: reading a field of a text that is no JSON is an error.
    document = "CASE WHEN json_valid(r.body) THEN r.body ELSE '{}' END"
    return (
        f"trim(CASE WHEN json_type({document}, '$.{name}') = 'NULL' THEN 'None' "
        f"ELSE coalesce(json_extract_string({document}, '$.{name}'), '') END)"
    )


_TRUTH = (
    "CASE WHEN json_valid(r.body) THEN "
    "CASE json_type(r.body, '$.ambiguous_case') WHEN 'BOOLEAN' THEN json_extract_string(r.body, '$.ambiguous_case') = 'true' "
    "WHEN 'VARCHAR' THEN json_extract_string(r.body, '$.ambiguous_case') <> '' "
    "WHEN 'UBIGINT' THEN json_extract_string(r.body, '$.ambiguous_case') <> '0' ELSE false END ELSE false END"
)


CTES = {
    "records": """
        SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id_registro, d.text AS texto, d.source AS canal_origem,
               strftime(DATE '2024-01-01' + CAST(d.doc_id % 366 AS INTEGER), '%Y-%m-%d') AS data,
               d.lang AS classe_macro,
               CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality || '_t' || l.toxic END AS classe_detalhada
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "prepared": f"""
        SELECT *, {joined('tokens')} AS processed
        FROM (SELECT *, {bare(lowered(tokens(clean(lines(blank('texto'))))))} AS tokens FROM records)""",
    "labelled": f"""
        SELECT doc_id, id_registro, texto, canal_origem, {strip(blank('classe_macro'))} AS classe_macro,
               {strip(blank('classe_detalhada'))} AS classe_detalhada, tokens, processed
        FROM prepared""",
    "modeling": """
        SELECT * FROM labelled WHERE classe_macro <> '' AND classe_detalhada <> '' AND processed <> ''""",
    "cases": """
        SELECT conv_id || '-' || turn AS id, text AS texto, role AS canal_origem
        FROM conversations""",
    "cases_prepared": f"""
        SELECT *, {joined('tokens')} AS processed
        FROM (SELECT *, {bare(lowered(tokens(clean(lines(blank('texto'))))))} AS tokens FROM cases)""",
    "predicted": f"""
        SELECT id, texto, canal_origem, processed, {_BEST_LANGUAGE} AS macro,
               {rounded(f'CASE WHEN {_ALL_HITS} > 0 THEN CAST({_TOP_HITS} AS DOUBLE) / ({_ALL_HITS}) ELSE 0 END', 4)}
                   AS confidence
        FROM (SELECT *, {_HITS} FROM cases_prepared)""",
    "measured": f"""
        SELECT *, length(texto) AS chars, {words('texto')} AS words
        FROM (SELECT * REPLACE ({strip(blank('texto'))} AS texto) FROM records)""",
    "quotas": """
        SELECT classe_macro, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, classe_macro)
                                              <= t - sum(base) OVER () THEN 1 ELSE 0 END AS quota
        FROM (SELECT classe_macro, c * t // n AS base, c * t % n AS rest, t
              FROM (SELECT classe_macro, count(*) AS c FROM modeling GROUP BY 1),
                   (SELECT count(*) AS n, CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t FROM modeling))""",
    "split": """
        SELECT m.*, CASE WHEN row_number() OVER (PARTITION BY m.classe_macro ORDER BY md5('42:' || id_registro)) <= q.quota
                         THEN 'test' ELSE 'train' END AS split
        FROM modeling m JOIN quotas q ON m.classe_macro = q.classe_macro""",
    "train": "SELECT * FROM split WHERE split = 'train'",
    "options": """
        SELECT classe_macro AS macro_class, count(*) AS record_count, count(DISTINCT classe_detalhada) AS detail_count,
               list_sort(list(DISTINCT classe_detalhada)) AS detail_options
        FROM train GROUP BY 1""",
    "top_detail": """
        SELECT classe_macro, classe_detalhada AS detail
        FROM (SELECT classe_macro, classe_detalhada, count(*) AS c FROM train GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY classe_macro ORDER BY c DESC, classe_detalhada) = 1""",
    "tested": f"""
        SELECT id_registro, doc_id, coalesce(texto, '') AS texto, classe_macro, classe_detalhada,
               {_BEST_LANGUAGE} AS macro
        FROM (SELECT *, {_HITS} FROM split WHERE split = 'test')""",
    "predictions": """
        SELECT 'macro' AS level, id_registro, doc_id, texto, classe_macro AS expected, macro AS predicted FROM tested
        UNION ALL
        SELECT 'detailed', id_registro, doc_id, texto, classe_detalhada, d.detail
        FROM tested t JOIN top_detail d ON t.macro = d.classe_macro
        UNION ALL
        SELECT 'detailed_oracle', id_registro, doc_id, texto, classe_detalhada, d.detail
        FROM tested t JOIN top_detail d ON t.classe_macro = d.classe_macro""",
    "counts": "SELECT level, expected, predicted, count(*) AS records FROM predictions GROUP BY ALL",
    "scores": """
        SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision,
               CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
               CASE WHEN support + guessed > 0 THEN 2 * hits / (support + guessed) ELSE 0 END AS f1_score
        FROM (SELECT level, label, CAST(sum(s) AS DOUBLE) AS support, CAST(sum(g) AS DOUBLE) AS guessed,
                     CAST(sum(h) AS DOUBLE) AS hits
              FROM (SELECT level, expected AS label, records AS s, 0 AS g,
                           CASE WHEN expected = predicted THEN records ELSE 0 END AS h FROM counts
                    UNION ALL SELECT level, predicted, 0, records, 0 FROM counts) GROUP BY ALL)""",
    "metrics": f"""
        SELECT level, {rounded('sum(hits) / sum(support)', 4)} AS accuracy,
               {rounded('sum(precision * support) / sum(support)', 4)} AS precision,
               {rounded('sum(recall * support) / sum(support)', 4)} AS recall,
               {rounded('sum(f1_score * support) / sum(support)', 4)} AS f1_score
        FROM scores GROUP BY level""",
    "contexts": """
        SELECT p.*, o.detail_options AS valid_classes, d.detail AS baseline_detail,
               'Canal de origem: ' || canal_origem || chr(10) || 'Texto do caso: ' || texto AS refiner_text
        FROM predicted p LEFT JOIN options o ON o.macro_class = p.macro LEFT JOIN top_detail d ON d.classe_macro = p.macro""",
    "lexical": f"""
        SELECT *, coalesce({_FIRST_CLASS}, valid_classes[1]) AS lexical_class, {_REFINED_PRIORITY} AS lexical_priority,
               {_AMBIGUOUS} AS lexical_ambiguous
        FROM contexts""",
    "responses": f"""
        SELECT id, {_RESPONSE_BODY} AS body, {_RESPONSE_ERROR} AS error FROM contexts""",
    "parsed": f"""
        SELECT c.*, r.body, r.error, {_FIELD('detailed_class')} AS p_class, {_FIELD('justification')} AS p_justification,
               {_FIELD('priority')} AS p_priority, {_TRUTH} AS p_ambiguous,
               CASE WHEN r.body IS NULL OR NOT json_valid(r.body) OR json_type(r.body) <> 'OBJECT' THEN {_quote(refine.INVALID_JSON)}
                    WHEN NOT list_contains(c.valid_classes, {_FIELD('detailed_class')}) THEN {_quote(refine.CLASS_NOT_ALLOWED)}
               END AS p_error
        FROM lexical c JOIN responses r ON r.id = c.id""",
    "refined": f"""
        SELECT *, CASE WHEN error = 'timeout' THEN 'mock' WHEN error = 'authentication' THEN 'indisponível'
                       WHEN p_error IS NULL AND body <> '' THEN 'remote' ELSE 'indisponível' END AS provider,
               CASE WHEN error = 'timeout' THEN {_quote(refine.CALL_FAILURES['timeout'])}
                    WHEN error = 'authentication' THEN {_quote(refine.BAD_CREDENTIALS)}
                    WHEN coalesce(body, '') = '' THEN {_quote(refine.EMPTY_ANSWER)} ELSE p_error END AS fallback_reason
        FROM parsed""",
    "terms": f"""
        SELECT *, {NGRAMS} AS terms FROM (SELECT *, {VECTOR_TOKENS} AS vt FROM modeling)""",
}

_NEEDS = {
    "prepared": ["records"],
    "labelled": ["prepared"],
    "modeling": ["labelled"],
    "cases_prepared": ["cases"],
    "predicted": ["cases_prepared"],
    "measured": ["records"],
    "quotas": ["modeling"],
    "split": ["quotas"],
    "train": ["split"],
    "options": ["train"],
    "top_detail": ["train"],
    "tested": ["split"],
    "predictions": ["tested", "top_detail"],
    "counts": ["predictions"],
    "scores": ["counts"],
    "metrics": ["scores"],
    "contexts": ["predicted", "options", "top_detail"],
    "lexical": ["contexts"],
    "responses": ["contexts"],
    "parsed": ["lexical", "responses"],
    "refined": ["parsed"],
    "terms": ["modeling"],
}


def _needed(body: str, extra: dict[str, str]) -> list[str]:
    found: list[str] = []

    def add(name: str) -> None:
        if name in found or name not in CTES:
            return
        for other in _NEEDS.get(name, []):
            add(other)
        found.append(name)

    text = body + " ".join(extra.values())
    for name in CTES:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            add(name)
    return found


def _sql(body: str, **extra: str) -> str:
    """``body`` behind the shared and the extra common table expressions it needs."""
    parts = [f"{name} AS ({CTES[name]})" for name in _needed(body, extra)]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _weights(docs: str, vocabulary: str, sublinear: bool = True, prefix: str = "") -> dict[str, str]:
    """CTEs ``{prefix}tf`` and ``{prefix}weights`` for documents with id, scope and terms."""
    damp = "1 + ln(tf)" if sublinear else "CAST(tf AS DOUBLE)"
    return {
        f"{prefix}tf": f"""
            SELECT id, scope, term, count(*) AS tf
            FROM (SELECT id, scope, unnest(terms) AS term FROM {docs}) GROUP BY ALL""",
        f"{prefix}raw": f"""
            SELECT t.id, t.scope, t.term, v.place, ({damp}) * v.idf AS w
            FROM {prefix}tf t JOIN {vocabulary} v ON t.scope = v.scope AND t.term = v.term""",
        f"{prefix}weights": f"""
            SELECT id, scope, term, place, w / sqrt(sum(w * w) OVER (PARTITION BY id, scope)) AS weight
            FROM {prefix}raw""",
    }


def _vocabulary(docs: str, size: int, name: str = "vocabulary") -> dict[str, str]:
    return {
        f"{name}_counts": f"""
            SELECT scope, term, count(*) AS total, count(DISTINCT id) AS df
            FROM (SELECT id, scope, unnest(terms) AS term FROM {docs}) GROUP BY ALL""",
        f"{name}_n": f"SELECT scope, count(*) AS n FROM {docs} GROUP BY scope",
        name: f"""
            SELECT c.scope, c.term, row_number() OVER (PARTITION BY c.scope ORDER BY total DESC, term) AS place,
                   total, df, n, ln((1.0 + n) / (1.0 + df)) + 1 AS idf
            FROM {name}_counts c JOIN {name}_n USING (scope)
            QUALIFY place <= {size}""",
    }


def retrieval(k: int, restrict: bool) -> dict[str, str]:
    """CTEs up to ``found``: id, rank, history_id, score, scope of the best ``k`` cases."""
    scope_key = "CASE WHEN scope = 'macro' THEN 'macro:' || macro ELSE 'all' END" if restrict else "'all'"
    history_scope = (
        "SELECT *, 'macro:' || classe_macro AS scope FROM terms UNION ALL BY NAME SELECT *, 'all' AS scope FROM terms"
        if restrict
        else "SELECT *, 'all' AS scope FROM terms"
    )
    kind = (
        f"CASE WHEN macro IN (SELECT {strip(blank('classe_macro'))} FROM records) THEN 'macro' ELSE 'global' END"
        if restrict
        else "'global'"
    )
    return {
        "history": f"""
            SELECT doc_id AS id, scope, terms, {strip('texto')} AS text, classe_macro, classe_detalhada
            FROM ({history_scope})""",
        **_vocabulary("history", 4000),
        **_weights("history", "vocabulary", prefix="h"),
        "scoped": f"SELECT *, {kind} AS scope FROM predicted",
        "asked": f"""
            SELECT id, {scope_key} AS scope, {NGRAMS} AS terms
            FROM (SELECT *, {VECTOR_TOKENS} AS vt FROM scoped WHERE processed <> '')""",
        **_weights("asked", "vocabulary", prefix="q"),
        "dots": """
            SELECT q.id AS qid, h.id AS hid, sum(q.weight * h.weight) AS score
            FROM qweights q JOIN hweights h ON q.scope = h.scope AND q.term = h.term GROUP BY ALL""",
        "pairs": """
            SELECT a.id, h.id AS hid, h.text, h.classe_macro, h.classe_detalhada,
                   coalesce(round(d.score, 6), 0) AS score
            FROM asked a JOIN history h ON a.scope = h.scope LEFT JOIN dots d ON d.qid = a.id AND d.hid = h.id""",
        "distinct_pairs": """
            SELECT * FROM pairs
            QUALIFY row_number() OVER (PARTITION BY id, text, classe_macro, classe_detalhada
                                       ORDER BY score DESC, hid) = 1""",
        "found": f"""
            SELECT d.id, d.hid, d.score, d.classe_macro, d.classe_detalhada, s.scope,
                   row_number() OVER (PARTITION BY d.id ORDER BY d.score DESC, d.hid) AS rank
            FROM distinct_pairs d JOIN scoped s ON s.id = d.id
            QUALIFY rank <= {k}""",
    }


_FOUND = f"""
    SELECT f.id, f.scope, f.rank, CAST(f.hid AS VARCHAR) AS history_id, coalesce(r.texto, '') AS text,
           f.classe_macro AS macro_class, f.classe_detalhada AS detailed_class,
           {rounded('f.score', 4)} AS similarity,
           format('{{:.1f}}%', {rounded('f.score', 4)} * 100) AS similarity_percent
    FROM found f JOIN records r ON r.doc_id = f.hid"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    cols = ", ".join(REQUIRED_COLUMNS)

    # sources
    out["schema_check"] = _sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS coluna_esperada, true AS presente_no_dataset, "
            f"count({name}) AS registros_preenchidos FROM records"
            for name in REQUIRED_COLUMNS
        )
    )
    out["dataset_summary"] = _sql(
        f"SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, '{cols}' AS columns FROM records"
    )
    out["dataset_preview"] = _sql(
        f"SELECT {', '.join(f'coalesce({name}, $$$$) AS {name}' for name in REQUIRED_COLUMNS)} "
        "FROM (SELECT * FROM records ORDER BY doc_id LIMIT 10)"
    )

    # text functions
    def per_record(name: str, expression: str, source: str = "records") -> None:
        out[name] = _sql(f"SELECT id_registro, {expression} FROM {source}")

    per_record("normalize_text", f"{lines('texto')} AS texto")
    per_record("clean_whitespace", f"{clean('texto')} AS texto")
    per_record("tokenize", f"{joined(tokens('texto'))} AS tokens, len({tokens('texto')}) AS n_tokens")
    per_record("strip_punct", f"{joined(bare(tokens('texto')))} AS tokens, len({bare(tokens('texto'))}) AS n_tokens")
    kept = f"list_filter({lowered(tokens('texto'))}, lambda t: t NOT IN ({_list(STOPWORDS)}))"
    per_record("remove_stopwords", f"{joined(kept)} AS tokens, len({kept}) AS n_tokens")
    per_record(
        "prepare_texts",
        "coalesce(texto, '') AS texto_original, processed AS texto_processado, len(tokens) AS n_tokens",
        "prepared",
    )
    per_record("summarize_text", f"{short('texto', 180)} AS resumo_180, {short('texto', 220)} AS resumo_220")
    out["reject_blank"] = _sql(
        f"""SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, {strip(blank('bare_text'))} AS texto,
                   CASE WHEN {strip(blank('bare_text'))} = '' THEN 'Informe um texto para executar a inferência.' END
                       AS reason
            FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN ' ' || chr(160) ELSE text END AS bare_text
                  FROM conversations)"""
    )

    # filters
    out["modeling_table"] = _sql(
        "SELECT id_registro, classe_macro, classe_detalhada, processed AS texto_processado FROM modeling"
    )
    out["macro_table"] = _sql(
        f"SELECT id_registro, {strip('texto')} AS texto, {strip('classe_macro')} AS classe_macro FROM records "
        f"WHERE {strip(blank('texto'))} <> '' AND {strip(blank('classe_macro'))} <> ''"
    )

    # profile
    out["text_stats"] = _sql(
        f"""SELECT {rounded('avg(chars)', 2)} AS avg_chars, {rounded('avg(words)', 2)} AS avg_words,
                   min(chars) AS shortest_size, max(chars) AS longest_size,
                   {short("first(texto ORDER BY chars, doc_id)", 180)} AS shortest_preview,
                   {short("first(texto ORDER BY chars DESC, doc_id)", 180)} AS longest_preview
            FROM measured"""
    )
    for name, column in (("dist_macro", "classe_macro"), ("dist_channel", "canal_origem")):
        out[name] = _sql(
            f"SELECT coalesce({column}, '{MISSING_LABEL}') AS label, count(*) AS value FROM records GROUP BY 1"
        )
    out["dist_detailed_top"] = _sql(
        f"SELECT coalesce(classe_detalhada, '{MISSING_LABEL}') AS label, count(*) AS value "
        "FROM records GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"
    )
    out["dist_detailed_labelled"] = _sql(
        "SELECT classe_detalhada AS label, count(*) AS value FROM records "
        "WHERE classe_detalhada IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
    )
    indicators = (
        ("total_registros", "count(*)"),
        ("total_colunas", "max(CAST(6 AS BIGINT))"),
        ("macroclasses", "count(DISTINCT classe_macro)"),
        ("classes_detalhadas", "count(DISTINCT classe_detalhada)"),
        ("canais_origem", "count(DISTINCT canal_origem)"),
    )
    out["overview"] = _sql(
        " UNION ALL ".join(f"SELECT '{name}' AS indicador, {value} AS valor FROM records" for name, value in indicators)
    )
    out["overview_landed"] = out["overview"]
    metrics = (
        ("media_caracteres", rounded("avg(chars)", 2)),
        ("media_palavras", rounded("avg(words)", 2)),
        ("menor_texto", "CAST(min(chars) AS DOUBLE)"),
        ("maior_texto", "CAST(max(chars) AS DOUBLE)"),
    )
    out["text_metrics"] = _sql(
        " UNION ALL ".join(f"SELECT '{name}' AS indicador, {value} AS valor FROM measured" for name, value in metrics)
    )
    out["macro_profile"] = _sql(
        f"""SELECT classe_macro, count(id_registro) AS registros, count(DISTINCT classe_detalhada) AS classes_detalhadas,
                   {rounded('avg(words)', 2)} AS media_palavras, {rounded('avg(chars)', 2)} AS media_caracteres
            FROM measured WHERE classe_macro IS NOT NULL GROUP BY classe_macro"""
    )
    out["hierarchy_summary"] = _sql(
        """SELECT s.classe_macro, registros, classes_detalhadas, coalesce(exemplos, '') AS exemplos_de_classes
           FROM (SELECT classe_macro, count(id_registro) AS registros, count(DISTINCT classe_detalhada)
                        AS classes_detalhadas
                 FROM records WHERE classe_macro IS NOT NULL GROUP BY 1) s
           LEFT JOIN (SELECT classe_macro, string_agg(classe_detalhada, ', ' ORDER BY classe_detalhada) AS exemplos
                      FROM (SELECT DISTINCT classe_macro, classe_detalhada FROM records
                            WHERE classe_detalhada IS NOT NULL
                            QUALIFY dense_rank() OVER (PARTITION BY classe_macro ORDER BY classe_detalhada) <= 6)
                      GROUP BY 1) e ON s.classe_macro = e.classe_macro"""
    )
    out["examples_by_macro"] = _sql(
        f"""SELECT coalesce(classe_macro, '{MISSING_LABEL}') AS macro_class, id_registro, {short(blank('texto'), 220)} AS texto,
                   row_number() OVER (PARTITION BY coalesce(classe_macro, '{MISSING_LABEL}') ORDER BY doc_id) AS posicao
            FROM records QUALIFY posicao <= 2"""
    )
    out["sample_by_macro"] = _sql(
        f"""SELECT classe_macro, classe_detalhada, canal_origem, {strip(blank('texto'))} AS texto
            FROM records WHERE classe_macro IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY classe_macro ORDER BY doc_id) <= 2"""
    )

    # features
    out["vector_tokens"] = _sql(
        f"SELECT id_registro, {joined('vt')} AS tokens, len(vt) AS n_tokens "
        f"FROM (SELECT id_registro, {VECTOR_TOKENS} AS vt FROM prepared)"
    )
    out["ngrams"] = _sql(
        f"SELECT id_registro, {joined(NGRAMS, '|')} AS terms, len({NGRAMS}) AS n_terms "
        f"FROM (SELECT id_registro, {VECTOR_TOKENS} AS vt FROM prepared)"
    )
    documents = {"docs": "SELECT id_registro AS id, 'all' AS scope, terms FROM terms"}
    by_macro = {
        "docs": "SELECT id_registro AS id, 'macro:' || classe_macro AS scope, terms FROM terms "
        "UNION ALL SELECT id_registro, 'all', terms FROM terms"
    }
    out["vocabulary"] = _sql(
        f"SELECT scope, term, place, total, df, n, {rounded('idf', 6)} AS idf FROM vocabulary",
        **by_macro,
        **_vocabulary("docs", 5000),
    )
    out["tfidf_weights"] = _sql(
        f"SELECT id, scope, place, {rounded('weight', 6)} AS weight FROM weights",
        **by_macro,
        **_vocabulary("docs", 5000),
        **_weights("docs", "vocabulary"),
    )
    raw_tokens = f"regexp_extract_all(strip_accents(lower(texto)), '[{WORD}]{{2,}}')"
    out["tfidf_plain"] = _sql(
        f"SELECT id, place, {rounded('weight', 6)} AS weight FROM weights",
        docs=f"""SELECT id_registro AS id, 'all' AS scope, {NGRAMS} AS terms
                 FROM (SELECT id_registro, {raw_tokens} AS vt FROM records WHERE {strip(blank('texto'))} <> '')""",
        **_vocabulary("docs", 5000),
        **_weights("docs", "vocabulary", sublinear=False),
    )

    # retrieval
    out["retrieval_scope"] = _sql(
        f"""SELECT id, macro,
                   CASE WHEN macro IN (SELECT {strip(blank('classe_macro'))} FROM records) THEN 'macro' ELSE 'global' END
                       AS scope
            FROM predicted"""
    )
    out["tfidf_cosine"] = _sql(
        f"SELECT id, CAST(hid AS VARCHAR) AS history_id, {rounded('score', 4)} AS similarity FROM found",
        **retrieval(1, restrict=False),
    )
    out["similar_topk"] = _sql(_FOUND, **retrieval(5, restrict=False))
    out["similar_cases"] = _sql(_FOUND, **retrieval(3, restrict=True))
    described = _FOUND.replace("FROM found f", f", {_priority('lower(r.texto)', HISTORY_HIGH_TERMS, DEFAULT_MEDIUM_TERMS)} AS priority FROM found f")
    out["few_shot_examples"] = _sql(
        f"""SELECT id, scope, count(*) AS used_count,
                   string_agg(rank || '|' || macro_class || '|' || detailed_class || '|' || priority
                              || '|Caso historico com similaridade TF-IDF de ' || similarity_percent
                              || ' em relacao ao texto atual.|' || md5(text), ';' ORDER BY rank) AS examples
            FROM ({described}) GROUP BY ALL""",
        **retrieval(3, restrict=True),
    )
    out["priority_history"] = _sql(
        f"""SELECT id_registro, {_priority("lower(coalesce(texto, ''))", HISTORY_HIGH_TERMS, DEFAULT_MEDIUM_TERMS)} AS priority,
                   {_priority("lower(coalesce(texto, ''))", HIGH_TERMS, MEDIUM_TERMS)} AS priority_test_terms
            FROM records"""
    )

    # split and evaluation
    out["stratified_split"] = _sql("SELECT id_registro, classe_macro, split FROM split")
    out["split_guards"] = _sql(
        """SELECT canal, sum(c)::BIGINT AS registros, count(*) AS classes, CASE
                  WHEN sum(c) < 6 THEN 'São necessários ao menos 6 registros válidos para treinar o baseline hierárquico.'
                  WHEN count(*) < 2 THEN 'O nível macro exige pelo menos duas classes distintas para treinamento.'
                  WHEN min(c) < 2 THEN 'Nem todas as classes macro possuem ao menos 2 exemplos. O split foi feito sem estratificação.'
                  WHEN ceil(sum(c) * CAST(0.2 AS DOUBLE)) < count(*) THEN 'O conjunto de teste seria menor que o número de '
                      || 'macroclasses. O split foi ajustado sem estratificação.'
                  ELSE 'estratificado' END AS resultado
           FROM (SELECT canal_origem AS canal, classe_macro, count(*) AS c FROM modeling GROUP BY ALL
                 UNION ALL SELECT 'todos', classe_macro, count(*) FROM modeling GROUP BY ALL)
           GROUP BY 1"""
    )
    out["class_weights"] = _sql(
        f"""SELECT classe_macro AS label, count(*) AS n_class,
                   {rounded('CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*))', 6)} AS weight
            FROM train GROUP BY 1"""
    )
    out["taxonomy"] = _sql(
        "SELECT macro_class, record_count, detail_count, array_to_string(detail_options, ', ') AS detail_options FROM options"
    )
    out["fallback_label"] = _sql(
        "SELECT classe_detalhada AS label, count(*) AS records FROM train GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
    )
    out["valid_details"] = _sql(
        """SELECT id, macro, array_to_string(valid_classes, ', ') AS valid_classes,
                  valid_classes IS NOT NULL AS known FROM contexts"""
    )
    out["confusion_matrix"] = _sql(
        """SELECT g.level, g.expected, g.predicted, coalesce(c.records, 0) AS records
           FROM (SELECT a.level, a.label AS expected, b.label AS predicted FROM scores a JOIN scores b ON a.level = b.level) g
           LEFT JOIN counts c ON c.level = g.level AND c.expected = g.expected AND c.predicted = g.predicted"""
    )
    out["weighted_metrics"] = _sql("SELECT * FROM metrics")
    report = f"""
        SELECT level, label, {rounded('precision', 4)} AS precision, {rounded('recall', 4)} AS recall,
               {rounded('f1_score', 4)} AS f1_score, CAST(support AS BIGINT) AS support FROM scores
        UNION ALL
        SELECT level, 'macro avg', {rounded('avg(precision)', 4)}, {rounded('avg(recall)', 4)},
               {rounded('avg(f1_score)', 4)}, CAST(sum(support) AS BIGINT) FROM scores GROUP BY level
        UNION ALL
        SELECT level, 'weighted avg', {rounded('sum(precision * support) / sum(support)', 4)},
               {rounded('sum(recall * support) / sum(support)', 4)},
               {rounded('sum(f1_score * support) / sum(support)', 4)}, CAST(sum(support) AS BIGINT)
        FROM scores GROUP BY level"""
    out["class_report"] = _sql(report)
    out["class_report_sorted"] = _sql(
        f"""SELECT label, {rounded('precision', 3)} AS precision, {rounded('recall', 3)} AS recall,
                   {rounded('f1_score', 3)} AS f1_score, CAST(support AS BIGINT) AS support
            FROM scores WHERE level = 'macro'"""
    )
    out["macro_f1"] = _sql(
        f"""SELECT 'accuracy' AS metrica, {rounded('sum(hits) / sum(support)', 4)} AS valor FROM scores WHERE level = 'macro'
            UNION ALL SELECT 'macro_f1', {rounded('avg(f1_score)', 4)} FROM scores WHERE level = 'macro'
            UNION ALL SELECT 'registros_teste', sum(support) FROM scores WHERE level = 'macro'
            UNION ALL SELECT 'registros_treino', CAST(count(*) AS DOUBLE) FROM train
            UNION ALL SELECT 'classes_macro', CAST(count(DISTINCT classe_macro) AS DOUBLE) FROM train"""
    )
    out["prediction_examples"] = _sql(
        f"""SELECT level, expected = predicted AS is_correct, id_registro, expected, predicted, {short('texto', 220)} AS texto,
                   row_number() OVER (PARTITION BY level, expected = predicted ORDER BY doc_id) AS posicao
            FROM predictions QUALIFY posicao <= 5"""
    )
    out["error_propagation"] = _sql(
        f"""SELECT *, CASE WHEN propagation_gap >= 0.1 THEN {_quote(evaluate._STRONG_PROPAGATION)}
                           WHEN propagation_gap > 0 THEN {_quote(evaluate._SOME_PROPAGATION)}
                           ELSE {_quote(evaluate._NO_PROPAGATION)} END AS propagation_message,
                   CASE WHEN macro_accuracy < 0.75 THEN {_quote(evaluate._UNSTABLE_MACRO)}
                        ELSE {_quote(evaluate._STABLE_MACRO)} END AS genai_role
            FROM (SELECT *, {rounded('greatest(detailed_accuracy_with_true_macro - detailed_accuracy, 0)', 4)} AS propagation_gap
                  FROM (SELECT max(accuracy) FILTER (level = 'macro') AS macro_accuracy,
                               max(accuracy) FILTER (level = 'detailed') AS detailed_accuracy,
                               max(accuracy) FILTER (level = 'detailed_oracle') AS detailed_accuracy_with_true_macro
                        FROM metrics))"""
    )
    out["risk_classes"] = _sql(
        f"""SELECT label, recall, support, 'A classe ' || chr(39) || label || chr(39) || ' pediu atenção, com recall ' || CAST(recall AS VARCHAR)
                   || ' e suporte ' || support || ', o que sugere risco maior de confusão no detalhamento.' AS risk_pattern
            FROM ({report}) WHERE level = 'detailed' AND label NOT IN ('macro avg', 'weighted avg')
            ORDER BY recall, support, label LIMIT 3"""
    )

    # refinement and routing
    out["lexical_refine"] = _sql("SELECT id, macro, lexical_class AS detailed_class FROM lexical")
    out["priority_refine"] = _sql(
        f"""SELECT id, lexical_priority AS priority,
                   {_priority('lower(refiner_text)', HIGH_TERMS, MEDIUM_TERMS)} AS priority_test_terms FROM lexical"""
    )
    out["ambiguity"] = _sql("SELECT id, lexical_ambiguous AS ambiguous_case FROM lexical")
    out["parse_responses"] = _sql(
        f"""SELECT id, body, coalesce(error, p_error) AS error,
                   CASE WHEN error IS NOT NULL THEN 'failed' WHEN p_error IS NULL THEN 'ok' ELSE 'invalid' END AS status,
                   CASE WHEN usable THEN p_class END AS detailed_class,
                   CASE WHEN usable THEN CASE WHEN p_justification = '' THEN {_quote(refine.NO_JUSTIFICATION)}
                        ELSE p_justification END END AS justification,
                   CASE WHEN usable THEN CASE WHEN p_priority = '' THEN {_quote(refine.NO_PRIORITY)}
                        ELSE p_priority END END AS priority,
                   CASE WHEN usable THEN p_ambiguous END AS ambiguous_case
            FROM (SELECT *, error IS NULL AND p_error IS NULL AS usable FROM parsed)"""
    )
    out["refine_with_fallback"] = _sql(
        f"""SELECT id, provider, 'remote' AS requested_provider, fallback_reason,
                   CASE provider WHEN 'mock' THEN 'mock' WHEN 'remote' THEN 'api' ELSE 'degradado' END AS mode,
                   CASE WHEN provider = 'indisponível' THEN 'baseline_only' ELSE 'ok' END AS status,
                   CASE provider WHEN 'mock' THEN lexical_class WHEN 'remote' THEN p_class ELSE baseline_detail END
                       AS detailed_class,
                   CASE provider WHEN 'mock' THEN {_quote(refine.LEXICAL_JUSTIFICATION)}
                                 WHEN 'remote' THEN CASE WHEN p_justification = '' THEN {_quote(refine.NO_JUSTIFICATION)}
                                                         ELSE p_justification END
                                 ELSE {_quote(refine.DEGRADED_JUSTIFICATION)} END AS justification,
                   CASE provider WHEN 'mock' THEN lexical_priority
                                 WHEN 'remote' THEN CASE WHEN p_priority = '' THEN {_quote(refine.NO_PRIORITY)} ELSE p_priority END
                                 ELSE {_quote(refine.NO_PRIORITY)} END AS priority,
                   CASE provider WHEN 'mock' THEN lexical_ambiguous WHEN 'remote' THEN p_ambiguous ELSE false END AS ambiguous_case
            FROM refined"""
    )
    quoted = "CAST(to_json({}) AS VARCHAR)".format
    shots = f"""
        SELECT id, count(*) AS n, string_agg('{{' || chr(10) || '      "text": ' || {quoted('text')}
                 || ',' || chr(10) || '      "macro_class": ' || {quoted('macro_class')}
                 || ',' || chr(10) || '      "detailed_class": ' || {quoted('detailed_class')}
                 || ',' || chr(10) || '      "justification": "Caso historico com similaridade TF-IDF de ' || similarity_percent
                 || ' em relacao ao texto atual."'
                 || ',' || chr(10) || '      "priority": ' || {quoted('priority')}
                 || ',' || chr(10) || '      "ambiguous_case": false' || chr(10) || '    }}',
               ',' || chr(10) || '    ' ORDER BY rank) AS shots
        FROM ({described}) GROUP BY id"""
    instruction_lines = " || ',' || chr(10) || '    ' || ".join(_quote(f'"{line}"') for line in refine.INSTRUCTIONS)
    out["build_prompts"] = _sql(
        f"""SELECT c.id, coalesce(s.n, 0) AS few_shot_count,
                   '{{' || chr(10) || '  "task": ' || {_quote('"' + refine.TASK + '"')}
                   || ',' || chr(10) || '  "baseline_role": ' || {_quote('"' + refine.BASELINE_ROLE + '"')}
                   || ',' || chr(10) || '  "instructions": [' || chr(10) || '    ' || {instruction_lines}
                   || chr(10) || '  ],' || chr(10) || '  "predicted_macro": ' || {quoted('macro')}
                   || ',' || chr(10) || '  "valid_detailed_classes": [' || chr(10) || '    '
                   || array_to_string(list_transform(valid_classes, lambda v: {quoted('v')}), ',' || chr(10) || '    ')
                   || chr(10) || '  ],' || chr(10) || '  "few_shot_examples": '
                   || CASE WHEN s.n IS NULL THEN '[]' ELSE '[' || chr(10) || '    ' || s.shots || chr(10) || '  ]' END
                   || ',' || chr(10) || '  "text": ' || {quoted('refiner_text')} || chr(10) || '}}' AS prompt
            FROM contexts c LEFT JOIN shots s ON s.id = c.id""",
        **retrieval(3, restrict=True),
        shots=shots,
    )
    out["refine"] = _sql(
        f"""SELECT l.id, 'mock' AS provider, 'mock' AS requested_provider, 'mock' AS mode, 'ok' AS status,
                   CAST(NULL AS VARCHAR) AS fallback_reason, lexical_class AS detailed_class,
                   {_quote(refine.LEXICAL_JUSTIFICATION)} AS justification, lexical_priority AS priority,
                   lexical_ambiguous AS ambiguous_case, baseline_detail, CAST(coalesce(f.n, 0) AS INTEGER) AS few_shot_count
            FROM lexical l LEFT JOIN (SELECT id, count(*) AS n FROM found GROUP BY 1) f ON f.id = l.id""",
        **retrieval(3, restrict=True),
    )
    band = "CASE WHEN confidence >= 0.75 THEN 'alta' WHEN confidence >= 0.45 THEN 'media' ELSE 'baixa' END"
    out["confidence_band"] = _sql(
        f"""SELECT id, confidence, {band} AS confidence_band, format('{{:.1f}}%', confidence * 100) AS confidence_percent
            FROM predicted"""
    )
    rules = (
        ("provider = 'indisponível'", routing._REFINER_UNUSABLE),
        ("final_ambiguous OR band = 'baixa'", routing._UNCERTAIN),
        ("band = 'media'", routing._PLAUSIBLE),
        ("lower(trim(final_priority)) = 'alta'", routing._URGENT),
        ("true", routing._AUTOMATIC),
    )

    def outcome(at: int) -> str:
        def literal(value) -> str:
            return str(value).lower() if isinstance(value, bool) else _quote(value)

        return "CASE " + " ".join(f"WHEN {rule} THEN {literal(values[at])}" for rule, values in rules) + " END"

    out["routing"] = _sql(
        f"""SELECT id, band AS confidence_level,
                   {', '.join(f'{outcome(at)} AS {name}' for at, name in enumerate(routing._FIELDS))}
            FROM (SELECT *, {band} AS band,
                         CASE provider WHEN 'mock' THEN lexical_ambiguous WHEN 'remote' THEN p_ambiguous ELSE false END
                             AS final_ambiguous,
                         CASE provider WHEN 'mock' THEN lexical_priority WHEN 'remote' THEN p_priority ELSE '' END
                             AS final_priority
                  FROM refined)"""
    )

    # files and composite jobs
    def missing(name: str) -> str:
        return f"CASE WHEN {name} NOT IN ({_list(NA_TOKENS)}) THEN {name} END AS {name}"

    out["csv_scan"] = _sql(f"SELECT {', '.join(missing(name) for name in REQUIRED_COLUMNS)} FROM records")
    out["land_batch"] = _sql(f"SELECT {cols}, 'upload' AS source, 'first' AS batch FROM records")
    out["latest_batch"] = _sql(
        f"""SELECT {cols}, '007' AS batch FROM records
            WHERE classe_macro IS NULL OR classe_macro NOT IN ('de', 'es', 'fr')"""
    )
    stats = ("avg_chars", "avg_words", "shortest_size", "longest_size", "shortest_preview", "longest_preview")
    out["eda_report"] = _sql(
        " UNION ALL ".join(
            [
                f"SELECT 'macro' AS section, label, value::VARCHAR AS value FROM ({out['dist_macro']})",
                f"SELECT 'channel', label, value::VARCHAR FROM ({out['dist_channel']})",
                f"SELECT 'detailed_top', label, value::VARCHAR FROM ({out['dist_detailed_top']})",
                f"SELECT 'overview', indicador, valor::VARCHAR FROM ({out['overview']})",
                f"SELECT 'dataset', columns, row_count::VARCHAR FROM ({out['dataset_summary']})",
                *[f"SELECT 'text_stats', '{name}', {name}::VARCHAR FROM ({out['text_stats']})" for name in stats],
                "SELECT 'examples_by_macro', macro_class || '|' || posicao || '|' || id_registro, md5(texto) "
                f"FROM ({out['examples_by_macro']})",
            ]
        )
    )
    return out
