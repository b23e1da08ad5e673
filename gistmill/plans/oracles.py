"""DuckDB SQL for the registered queries, written apart from the Spark code.

Shared parts are common table expressions; ``_query`` puts the needed ones in
front of a final SELECT.
"""

from gistmill import fixed_values as fx

WS = fx.WS
_CTES: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _query(final: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({_CTES[name]})" for name in ctes) + "\n" + final


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{fx.WS_CHARS}]+')) AS BIGINT)"


def _first_sentence(x: str) -> str:
    """Before the first boundary; RE2 has no look-around, so the capital is matched and left out."""
    trimmed = _strip(x)
    found = f"regexp_extract({trimmed}, '^(.*?[.!?]){WS}+[A-Z]', 1, 's')"
    return _strip(f"CASE WHEN {found} = '' THEN {trimmed} ELSE {found} END")


def _last_sentence(x: str) -> str:
    found = f"regexp_extract({x}, '^(.*[.!?]){WS}+([A-Z].*)$', 2, 's')"
    return f"CASE WHEN {found} = '' THEN {x} ELSE {found} END"


def _clean(x: str) -> str:
    preamble = fx.PREAMBLE.replace("(?iu)", "(?i)")
    for pattern, kept in (
        (preamble, ""),
        (fx.LABEL_LINE, ""),
        (rf"(?s)\A[{fx.OPENING_QUOTES}](.*)[{fx.CLOSING_QUOTES}]\z", r"\1"),
        (r"(?s)\A(?:\*|\*([^*].*)\*)\z", r"\1"),
    ):
        x = _strip(f"regexp_replace({_strip(x)}, {_q(pattern)}, '{kept}')")
    return x


# --- corpus -----------------------------------------------------------------------

_CTES["raw"] = """
    SELECT doc_id AS pos, string_split(text, chr(10)) AS lines,
           CASE doc_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
    FROM documents"""
_CTES["cleaned"] = f"""
    SELECT split, pos, {_squeeze("array_to_string(list_slice(lines, 1, len(lines) - 1), ' ')")} AS abstract,
           {_squeeze("lines[len(lines)]")} AS summary
    FROM raw WHERE len(lines) > 1"""
_CTES["papers"] = """
    SELECT split, substr(sha256(abstract), 1, 16) AS id, abstract, summary, 'documents' AS source, pos
    FROM cleaned WHERE length(abstract) >= 100 AND length(summary) >= 10"""
_CTES["records"] = "SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY split, id ORDER BY pos) = 1"
CORPUS = ("raw", "cleaned", "papers", "records")

_CTES["runs"] = f"""
    SELECT split, id, 'extractive_first_sentence' AS name, summary, {_first_sentence('abstract')} AS prediction FROM records
    UNION ALL SELECT split, id, 'lead_20_words', summary,
           array_to_string(list_slice(string_split(abstract, ' '), 1, 20), ' ') FROM records
    UNION ALL SELECT split, id, 'qlora_last_sentence', summary, {_last_sentence('abstract')} FROM records"""
_CTES["pairs"] = """
    SELECT u.conv_id, u.turn, u.text AS reference, a.text AS prediction
    FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""

# --- ROUGE: texts(k, prediction, reference) -> scores per k -------------------------


def _tokens(x: str) -> str:
    words = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"CASE WHEN {words} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({words}, ' ') END"


def _shape(x: str) -> str:
    return (
        f"list_reduce(list_prepend('', string_split({x}, '')), lambda a, c: a || CASE WHEN c = '' THEN '' "
        "WHEN c IN ('a','e','i','o','u') OR (c = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"
    )


def _stem_step(previous: str, new_word: str) -> str:
    return f"SELECT word, {new_word} AS w, {_shape(new_word)} AS s FROM {previous}"


def _rules(rules, condition: str) -> str:
    """CASE over suffixes; ``condition`` sees the shape of the stem as {m} and the stem as {stem}."""
    whens = []
    for suffix, new in rules:
        stem = f"left(w, length(w) - {len(suffix)})"
        measured = f"left(s, length(s) - {len(suffix)})"
        accept = condition.format(m=measured, stem=stem, suffix=suffix)
        whens.append(f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {accept} THEN {stem} || '{new}' ELSE w END")
    return "CASE " + " ".join(whens) + " ELSE w END"


def _cut(n: int, add: str = "") -> str:
    return f"left(w, length(w) - {n}) || '{add}'"


def _m(shape: str, at_least: int) -> str:
    return f"{shape} LIKE '%{'vc%' * at_least}'"


def _m1(shape: str) -> str:
    return f"({_m(shape, 1)} AND NOT {_m(shape, 2)})"


def _short(stem: str, shape: str) -> str:
    return f"({shape} = 'vc' OR ({shape} LIKE '%cvc' AND right({stem}, 1) NOT IN ('w', 'x', 'y')))"


_after_ed = """CASE
    WHEN st LIKE '%at' OR st LIKE '%bl' OR st LIKE '%iz' THEN st || 'e'
    WHEN length(st) > 1 AND right(st, 1) = left(right(st, 2), 1) AND right(ss, 1) = 'c'
        THEN CASE WHEN right(st, 1) IN ('l', 's', 'z') THEN st ELSE left(st, length(st) - 1) END
    WHEN {m1} AND {short} THEN st || 'e' ELSE st END""".format(m1=_m1("ss"), short=_short("st", "ss"))

_CTES["vocab0"] = """
    SELECT DISTINCT word FROM (SELECT unnest(list_concat(p, r)) AS word FROM tokenized)"""
_CTES["stem0"] = f"SELECT word, word AS w, {_shape('word')} AS s FROM vocab0 WHERE length(word) > 3"
_CTES["stem1a"] = _stem_step(
    "stem0",
    f"""CASE WHEN w LIKE '%ies' THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END
        WHEN w LIKE '%sses' THEN {_cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut(1)} ELSE w END""",
)
_CTES["stem1b"] = f"""
    SELECT word, w, s,
           CASE WHEN w LIKE '%ed' AND contains(left(s, length(s) - 2), 'v') THEN left(w, length(w) - 2)
                WHEN w LIKE '%ing' AND contains(left(s, length(s) - 3), 'v') THEN left(w, length(w) - 3) END AS st,
           left(s, length(st)) AS ss
    FROM stem1a"""
_CTES["stem1c"] = _stem_step(
    "stem1b",
    f"""CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END
        WHEN w LIKE '%eed' THEN CASE WHEN {_m('left(s, length(s) - 3)', 1)} THEN {_cut(1)} ELSE w END
        WHEN st IS NULL THEN w ELSE {_after_ed} END""",
)
_CTES["stem1d"] = _stem_step(
    "stem1c", f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND left(right(s, 2), 1) = 'c' THEN {_cut(1, 'i')} ELSE w END"
)
_CTES["stem2a"] = _stem_step(
    "stem1d", f"CASE WHEN w LIKE '%alli' AND {_m('left(s, length(s) - 4)', 1)} THEN {_cut(2)} ELSE w END"
)
_CTES["stem2b"] = _stem_step(
    "stem2a",
    f"CASE WHEN w LIKE '%logi' THEN CASE WHEN {_m('left(s, length(s) - 3)', 1)} THEN {_cut(1)} ELSE w END ELSE "
    + _rules(fx.STEM_STEP2, _m("{m}", 1)) + " END",
)
_CTES["stem3"] = _stem_step("stem2b", _rules(fx.STEM_STEP3, _m("{m}", 1)))
_CTES["stem4"] = _stem_step(
    "stem3",
    _rules(
        [(s, "") for s in fx.STEM_STEP4],
        _m("{m}", 2) + " AND ('{suffix}' <> 'ion' OR right({stem}, 1) IN ('s', 't'))",
    ),
)
_CTES["stem5a"] = _stem_step(
    "stem4",
    f"""CASE WHEN w LIKE '%e' AND ({_m('left(s, length(s) - 1)', 2)} OR ({_m1('left(s, length(s) - 1)')}
        AND NOT {_short('left(w, length(w) - 1)', 'left(s, length(s) - 1)')})) THEN {_cut(1)} ELSE w END""",
)
_exceptions = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in fx.STEM_EXCEPTIONS.items() if len(w) >= fx.STEM_MIN_CHARS)
_CTES["stems"] = f"""
    SELECT word, CASE word {_exceptions} ELSE
           CASE WHEN w LIKE '%ll' AND {_m('left(s, length(s) - 1)', 2)} THEN {_cut(1)} ELSE w END END AS stem
    FROM stem5a UNION ALL SELECT word, word FROM vocab0 WHERE length(word) <= 3"""
STEMS = (
    "vocab0", "stem0", "stem1a", "stem1b", "stem1c", "stem1d", "stem2a", "stem2b", "stem3", "stem4", "stem5a", "stems",
)

_CTES["tokenized"] = f"SELECT k, {_tokens('prediction')} AS p, {_tokens('reference')} AS r FROM texts"
_CTES["stemmed"] = """
    SELECT t.k, coalesce(list(v.stem ORDER BY t.i) FILTER (WHERE t.side = 1), []) AS p,
           coalesce(list(v.stem ORDER BY t.i) FILTER (WHERE t.side = 2), []) AS r
    FROM (SELECT k, 1 AS side, unnest(p) AS word, generate_subscripts(p, 1) AS i FROM tokenized
          UNION ALL SELECT k, 2, unnest(r), generate_subscripts(r, 1) FROM tokenized) t
    JOIN stems v ON v.word = t.word GROUP BY t.k"""
_CTES["plain"] = "SELECT * FROM tokenized"


def _gram_ctes(tokens: str) -> dict[str, str]:
    bigrams = "list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"
    ctes = {}
    for name, of in (("hits1", "{x}"), ("hits2", bigrams)):
        sides = [
            f"SELECT k, g, count(*) AS n FROM (SELECT k, unnest({of.format(x=x)}) AS g FROM {tokens}) GROUP BY k, g"
            for x in ("p", "r")
        ]
        ctes[name] = (
            f"SELECT a.k, CAST(sum(least(a.n, b.n)) AS BIGINT) AS hits FROM ({sides[0]}) a JOIN ({sides[1]}) b "
            "ON a.k = b.k AND a.g = b.g GROUP BY a.k"
        )
    # LCS as the longest increasing run of matching places, with a list of smallest run ends
    places = "SELECT k, unnest({x}) AS g, generate_subscripts({x}, 1) AS i FROM " + tokens
    ctes["matches"] = (
        f"SELECT a.k, list([b.i] ORDER BY a.i, b.i DESC) AS steps FROM ({places.format(x='p')}) a "
        f"JOIN ({places.format(x='r')}) b ON a.k = b.k AND a.g = b.g GROUP BY a.k"
    )
    ctes["hitsl"] = (
        "SELECT k, len(list_reduce(list_prepend(CAST([] AS BIGINT[]), steps), lambda ends, step: list_concat(list_concat("
        "list_filter(ends, lambda e: e < step[1]), step), list_slice(ends, "
        "len(list_filter(ends, lambda e: e < step[1])) + 2, len(ends))))) AS hits FROM matches"
    )
    return ctes


_CTES |= _gram_ctes("toks")


def _f(hits: str, p: str, r: str) -> str:
    return f"CASE WHEN coalesce({hits}, 0) > 0 THEN 2.0::DOUBLE * {hits} / ({p} + {r}) ELSE 0.0::DOUBLE END"


def _share(hits: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN coalesce({hits}, 0)::DOUBLE / {n} ELSE 0.0::DOUBLE END"


_UNI, _BI = ("len(t.p)", "len(t.r)"), ("greatest(len(t.p) - 1, 0)", "greatest(len(t.r) - 1, 0)")
_ROUGE_SQL = {"rouge1": ("hits1", _UNI), "rouge2": ("hits2", _BI), "rougeL": ("hitsl", _UNI)}


def _rouge(texts: str, sources: tuple[str, ...], stem: bool, metrics, final: str, details: bool = False) -> str:
    """``final`` reads ``scores(k, <metric>...)``."""
    ctes = {name: _CTES[name] for name in sources}
    ctes["texts"] = texts
    ctes["tokenized"] = _CTES["tokenized"]
    if stem:
        ctes |= {name: _CTES[name] for name in STEMS}
        ctes["toks"] = (
            "SELECT a.k, coalesce(s.p, []) AS p, coalesce(s.r, []) AS r FROM tokenized a LEFT JOIN ("
            + _CTES["stemmed"] + ") s ON a.k = s.k"
        )
    else:
        ctes["toks"] = _CTES["plain"]
    columns, joins = [], []
    for metric in metrics:
        hits, (p, r) = _ROUGE_SQL[metric]
        if metric == "rougeL":
            ctes["matches"] = _CTES["matches"]
        ctes[hits] = _CTES[hits]
        joins.append(f"LEFT JOIN {hits} ON {hits}.k = t.k")
        columns.append(f"{_f(f'{hits}.hits', p, r)} AS {metric}")
        if details:
            columns += [f"{_share(f'{hits}.hits', p)} AS {metric}_precision", f"{_share(f'{hits}.hits', r)} AS {metric}_recall"]
    ctes["scores"] = f"SELECT t.k, {', '.join(columns)} FROM toks t {' '.join(joins)}"
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + "\n" + final


_PAIR_TEXTS = "SELECT {'conv_id': conv_id, 'turn': turn} AS k, prediction, reference FROM pairs"
_RUN_TEXTS = "SELECT {'name': name, 'split': split, 'id': id} AS k, prediction, summary AS reference FROM runs"
ALL = ("rouge1", "rouge2", "rougeL")


def _on_pairs(metrics, stem: bool = False, details: bool = True) -> str:
    names = [c for m in metrics for c in ([m, f"{m}_precision", f"{m}_recall"] if details else [m])]
    return _rouge(_PAIR_TEXTS, ("pairs",), stem, metrics, f"SELECT k.conv_id AS conv_id, k.turn AS turn, {', '.join(names)} FROM scores", details)


def _on_runs(final: str, stem: bool = False, extra: str = "") -> str:
    """``final`` reads ``metrics(name, split, rouge1, rouge2, rougeL, n)`` or ``scores``."""
    means = (
        ", metrics AS (SELECT k.name AS name, k.split AS split, avg(rouge1) AS rouge1, avg(rouge2) AS rouge2, "
        f"avg(rougeL) AS \"rougeL\", count(*) AS n FROM scores GROUP BY ALL){extra}\n"
    )
    return _rouge(_RUN_TEXTS, (*CORPUS, "runs"), stem, ALL, means + final)


# --- tokens -----------------------------------------------------------------------

_SYSTEM = _q(f"<|system|>\n{fx.SYSTEM_PROMPT}\n<|end|>\n").replace("\n", "' || chr(10) || '")


def _prompt(abstract: str) -> str:
    nl = "chr(10)"
    return (
        f"({_SYSTEM} || '<|user|>' || {nl} || 'Abstract:' || {nl} || {abstract} || {nl} || {nl} || 'Write the TL;DR.' "
        f"|| {nl} || '<|end|>' || {nl} || '<|assistant|>' || {nl})"
    )


def _full(abstract: str, summary: str) -> str:
    return f"({_prompt(abstract)} || {summary} || chr(10) || '<|end|>' || chr(10))"


_CTES["rendered"] = f"SELECT split, id, pos, {_full('abstract', 'summary')} AS full_text, {_prompt('abstract')} AS prompt FROM records"
_CTES["placed"] = f"""
    SELECT split, id, pos, unnest(toks) AS token, generate_subscripts(toks, 1) AS i
    FROM (SELECT split, id, pos, string_split({_squeeze('full_text')}, ' ') AS toks FROM rendered)"""
_CTES["prompt_placed"] = f"""
    SELECT split, id, pos, unnest(toks) AS token, generate_subscripts(toks, 1) AS i
    FROM (SELECT split, id, pos, string_split({_squeeze('prompt')}, ' ') AS toks FROM rendered)"""


def _vocab(placed: str) -> str:
    return (
        "SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id "
        f"FROM (SELECT token, count(*) AS n FROM {placed} GROUP BY token)"
    )


_CTES["vocab"] = _vocab("placed")
_CTES["prompt_vocab"] = _vocab("prompt_placed")
_CTES["encoded"] = """
    SELECT split, id, list(token_id ORDER BY i) AS ids FROM placed JOIN vocab USING (token) GROUP BY split, id"""
_CTES["examples"] = f"""
    SELECT split, id, prompt_length, list_slice(ids, 1, {fx.TRAINING_MAX_LENGTH}) AS ids,
           list_transform(list_slice(ids, 1, {fx.TRAINING_MAX_LENGTH}),
                          lambda x, i: CASE WHEN i <= prompt_length THEN {fx.IGNORED_LABEL} ELSE x END) AS labels
    FROM encoded JOIN (SELECT split, id, {_words('prompt')} AS prompt_length FROM rendered) USING (split, id)"""
TOKENS = (*CORPUS, "rendered", "placed", "vocab", "encoded")


def _text_list(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def _ones(n: str) -> str:
    return f"list_transform(range({n}), lambda x: 1)"


def _fill(n: str, value: int) -> str:
    return f"list_transform(range({n}), lambda x: {value})"


_CTES["positions"] = f"""
    SELECT split, id, row_number() OVER (PARTITION BY split
           ORDER BY sha256('{fx.SHUFFLE_SEED}:' || split || ':' || id)) AS position FROM records"""
_CTES["batched"] = f"""
    SELECT *, (position - 1) // {fx.BATCH_SIZE} AS batch_id,
           max(len(ids)) OVER (PARTITION BY split, (position - 1) // {fx.BATCH_SIZE}) - len(ids) AS pad
    FROM examples JOIN positions USING (split, id)"""
_CTES["ranked"] = """
    SELECT split, id, position, n, block, row_number() OVER (PARTITION BY split, block ORDER BY n DESC, position) AS rank
    FROM (SELECT split, id, position, len(ids) AS n, (position - 1) // 1024 AS block FROM examples JOIN positions USING (split, id))"""
_CTES["in_batches"] = f"""
    WITH RECURSIVE opened AS (
        SELECT split, block, rank, n FROM ranked WHERE rank = 1
        UNION ALL SELECT r.split, r.block, r.rank, r.n FROM opened o JOIN ranked r
        ON r.split = o.split AND r.block = o.block AND r.rank = o.rank + greatest(1, {fx.BATCH_SIZE * fx.TRAINING_MAX_LENGTH} // greatest(o.n, 1))),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY block, rank) - 1 AS batch_id FROM opened)
    SELECT r.split, r.id, r.position, b.batch_id, r.n AS tokens, b.n AS padded
    FROM ranked r ASOF JOIN numbered b ON r.split = b.split AND r.block = b.block AND r.rank >= b.rank"""
_CTES["prompt_ids"] = f"""
    SELECT split, id, list_slice(list(token_id ORDER BY i), 1, {fx.PROMPT_MAX_LENGTH}) AS ids,
           row_number() OVER (PARTITION BY split ORDER BY min(pos)) AS position
    FROM prompt_placed JOIN prompt_vocab USING (token) GROUP BY split, id"""

# --- profile ----------------------------------------------------------------------

_CTES["lengths"] = f"""
    SELECT split, unnest(['abstract_tokens', 'summary_tokens']) AS measure,
           unnest([{_words('abstract')}, {_words('summary')}]) AS value FROM records"""
_CTES["ranges"] = f"""
    SELECT split, measure, min(value) AS lo, max(value) AS hi,
           CASE measure WHEN 'abstract_tokens' THEN {fx.ABSTRACT_BINS} ELSE {fx.SUMMARY_BINS} END AS bins
    FROM lengths GROUP BY split, measure"""

# --- history ----------------------------------------------------------------------

_CTES["history"] = """
    SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
           CASE WHEN event_type IN ('view', 'click', 'purchase') THEN value END AS train_loss,
           CASE WHEN event_type = 'signup' THEN value END AS eval_loss,
           CASE WHEN event_type = 'error' THEN value END AS learning_rate
    FROM events"""
_CTES["saved"] = f"SELECT * FROM history WHERE step % {fx.SAVE_EVERY_STEPS} = 0"

_WRAPPED = """CASE (conv_id + turn) % 8
    WHEN 0 THEN 'Here''s the TL;DR:' || chr(10) || text
    WHEN 1 THEN '  Sure! Here is a plain-language tl;dr — ' || text || chr(10)
    WHEN 2 THEN 'Summary of the text:' || chr(10) || chr(10) || text || '  '
    WHEN 3 THEN '"' || text || '"'
    WHEN 4 THEN '“' || text || '”'
    WHEN 5 THEN '*' || text || '*'
    WHEN 6 THEN '**' || text || '**'
    WHEN 7 THEN 'Here’s my brief TLDR:' || chr(10) || chr(10) || '"' || text || '"' END"""


def _poisson_case(draw: str) -> str:
    """Poisson(1) count of an 8-digit hex draw, by the distribution function."""
    from math import exp, factorial

    bounds, total = [], 0.0
    for k in range(13):
        total += exp(-1) / factorial(k)
        if round(total * 2**32) < 2**32:
            bounds.append(f"{round(total * 2**32):08x}")
    whens = " ".join(f"WHEN {draw} < '{bound}' THEN {k}" for k, bound in enumerate(bounds))
    return f"CASE {whens} ELSE {len(bounds)} END"


def _bootstrap() -> str:
    points = (("low", 0.025), ("mid", 0.5), ("high", 0.975))
    columns = ", ".join(
        f'round(quantile_cont({m}, {p}), 6) AS "{m}_{label}"' for m in ALL for label, p in points
    )
    return _on_runs(
        f"SELECT name, split, {columns} FROM replicates GROUP BY name, split",
        extra=f""", draws AS (
            SELECT k, rouge1, rouge2, "rougeL", block, j, substr(digest, 8 * j + 1, 8) AS draw
            FROM (SELECT *, md5('0:' || k.id || ':' || block) AS digest
                  FROM (SELECT *, unnest(range(250)) AS block FROM scores)), (SELECT unnest(range(4)) AS j)),
        weighted AS (SELECT *, {_poisson_case('draw')} AS w FROM draws),
        replicates AS (
            SELECT k.name AS name, k.split AS split, {', '.join(f'sum(w * {m}) / sum(w) AS "{m}"' for m in ALL)}
            FROM weighted GROUP BY k.name, k.split, block, j)""",
    )


_COUNTS = "SELECT k, g, count(*) AS n FROM (SELECT k, unnest({x}) AS g FROM tokenized) GROUP BY k, g"
_BEST = (
    "SELECT a.k, sum(a.n * a.best) / sum(a.n) AS v FROM (SELECT x.k, x.g, any_value(x.n) AS n, "
    "max(list_cosine_similarity(x.vec, y.vec)) AS best FROM {left} x JOIN {right} y ON x.k = y.k GROUP BY x.k, x.g) a GROUP BY a.k"
)
#: matched(k, f1) over tokenized(k, p, r)
_MATCHES = f"""
    words AS (SELECT g, (row_number() OVER (ORDER BY g) - 1) % (SELECT count(*) FROM embeddings) + 1 AS number
              FROM (SELECT DISTINCT unnest(list_concat(p, r)) AS g FROM tokenized)),
    vectors AS (SELECT g, CAST(embedding AS DOUBLE[]) AS vec FROM words JOIN (
        SELECT embedding, row_number() OVER (ORDER BY vec_id) AS number FROM embeddings) USING (number)),
    pc AS (SELECT c.*, vec FROM ({_COUNTS.format(x='p')}) c JOIN vectors USING (g)),
    rc AS (SELECT c.*, vec FROM ({_COUNTS.format(x='r')}) c JOIN vectors USING (g)),
    pr AS ({_BEST.format(left='pc', right='rc')}), re AS ({_BEST.format(left='rc', right='pc')}),
    matched AS (
        SELECT t.k AS k, CASE WHEN coalesce(pr.v + re.v, 0) = 0 THEN 0 ELSE 2 * pr.v * re.v / (pr.v + re.v) END AS f1
        FROM tokenized t LEFT JOIN pr ON pr.k = t.k LEFT JOIN re ON re.k = t.k)"""


def _embedding_f1() -> str:
    return f"""
    WITH pairs AS ({_CTES['pairs']}), texts AS ({_PAIR_TEXTS}), tokenized AS ({_CTES['tokenized']}), {_MATCHES}
    SELECT k.conv_id AS conv_id, k.turn AS turn, round(f1, 6) AS bertscore_f1 FROM matched"""


def _results_with_old_run(include_deprecated: bool) -> str:
    shown = "" if include_deprecated else "WHERE coalesce(d.section, 2) <> 1"
    return _on_runs(
        f"""SELECT m.split, coalesce(d.section, CAST(2 AS INTEGER)) AS section, d.ord, m.name, coalesce(d.label, m.name) AS label,
                  round(m.rouge1, 3) AS rouge1, round(m.rouge2, 3) AS rouge2, round(m."rougeL", 3) AS "rougeL",
                  round(b.f1, 3) AS bertscore_f1, round(w.words, 1) AS words, coalesce(d.section, 2) = 0 AS is_best
           FROM metrics m JOIN words_out w USING (name, split) JOIN means b USING (name, split)
           LEFT JOIN display d ON d.name = m.name {shown}""",
        extra=f""", {_MATCHES},
        means AS (SELECT k.name AS name, k.split AS split, avg(f1) AS f1 FROM matched GROUP BY ALL),
        words_out AS (SELECT name, split, avg({_words('prediction')}) AS words FROM runs GROUP BY ALL),
        display AS (SELECT * FROM (VALUES ('qlora_last_sentence', 'Last sentence', CAST(0 AS INTEGER), CAST(0 AS INTEGER)),
                                          ('lead_20_words', 'Lead (deprecated)', 0, 1)) v(name, label, ord, section))""",
    )


def all_oracles() -> dict[str, str]:
    rounded = ", ".join(f'round({m}, 6) AS "{m}"' for m in ALL)
    documents = f"SELECT doc_id AS k, {_first_sentence('text')} AS prediction, text AS reference FROM documents"
    return {
        "prepare_records": _query("SELECT * FROM papers", "raw", "cleaned", "papers"),
        "dedupe_first": _query("SELECT * FROM records", *CORPUS),
        "split_manifest": _query("SELECT split, count(*) AS n FROM records GROUP BY split", *CORPUS),
        "shuffle_order": _query("SELECT * FROM positions", *CORPUS, "positions"),
        "shuffle_sample": _query(
            f"""SELECT CASE WHEN length(abstract) > {fx.EXAMPLE_CHARS} THEN substr(abstract, 1, {fx.EXAMPLE_CHARS}) || '…'
                ELSE abstract END AS abstract, summary FROM records WHERE split = 'train'
                ORDER BY sha256('{fx.EXAMPLE_SEED}:' || id), id LIMIT {fx.EXAMPLE_ROWS}""",
            *CORPUS,
        ),
        "head_subset": _query(
            f"SELECT pos, id, abstract, summary FROM records WHERE split = 'val' ORDER BY pos LIMIT {fx.EVAL_SUBSET_ROWS}",
            *CORPUS,
        ),
        "first_sentence": f"SELECT doc_id, {_first_sentence('text')} AS sentence FROM documents",
        "strip_preamble": f"SELECT conv_id, turn, {_clean('completion')} AS cleaned FROM (SELECT conv_id, turn, {_WRAPPED} AS completion FROM conversations)",
        "render_chat": _query(
            f"SELECT conv_id, turn, {_prompt('reference')} AS prompt, {_full('reference', 'prediction')} AS full FROM pairs", "pairs"
        ),
        "predict_batched": _query(
            f"SELECT split, id, summary, {_clean(_first_sentence('abstract'))} AS prediction FROM records", *CORPUS
        ),
        "attach_predictions": _query(
            f"SELECT split, id, summary, {_first_sentence('abstract')} AS prediction FROM records", *CORPUS
        ),
        "rouge_by_language": _rouge(
            documents, (), False, ["rouge1"],
            "SELECT lang, round(avg(rouge1), 6) AS rouge1, count(*) AS n FROM scores JOIN documents ON doc_id = k GROUP BY lang",
        ),
        "rouge1": _on_pairs(["rouge1"]),
        "rouge2": _on_pairs(["rouge2"]),
        "rouge_l": _on_pairs(["rougeL"]),
        "rouge_stemmed": _on_pairs(ALL, stem=True, details=False),
        "corpus_scores": _on_runs(f"SELECT name, split, {rounded}, n FROM metrics"),
        "corpus_scores_stemmed": _on_runs(f"SELECT name, split, {rounded}, n FROM metrics", stem=True),
        "alignment_check": """
            SELECT conv_id, turn, CAST(sum(p) AS BIGINT) AS n_predictions, CAST(sum(r) AS BIGINT) AS n_references
            FROM (SELECT conv_id, turn, 0 AS p, 1 AS r FROM conversations WHERE role = 'user'
                  UNION ALL SELECT conv_id, turn - 1, 1, 0 FROM conversations WHERE role = 'assistant')
            GROUP BY conv_id, turn HAVING sum(p) <> sum(r)""",
        "embedding_f1": _embedding_f1(),
        "embedding_f1_shuffled": _embedding_f1(),
        "bootstrap_ci": _bootstrap(),
        "length_profile": _query(
            """SELECT split, measure, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
               round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max
               FROM lengths GROUP BY split, measure""",
            *CORPUS, "lengths",
        ),
        "compression_ratio": _query(
            f"""SELECT split, round(avg(ratio), 6) AS mean, round(quantile_cont(ratio, 0.5), 6) AS median
                FROM (SELECT split, {_words('summary')}::DOUBLE / greatest({_words('abstract')}, 1) AS ratio FROM records)
                GROUP BY split""",
            *CORPUS,
        ),
        "length_histogram": _query(
            """SELECT e.split, e.measure, CAST(e.bin AS INTEGER) AS bin,
                      round(CASE WHEN hi = lo THEN lo - 0.5 + e.bin::DOUBLE / bins ELSE lo + (hi - lo)::DOUBLE * e.bin / bins END, 6) AS low,
                      round(CASE WHEN hi = lo THEN lo - 0.5 + (e.bin + 1)::DOUBLE / bins ELSE lo + (hi - lo)::DOUBLE * (e.bin + 1) / bins END, 6) AS high,
                      coalesce(f.n, 0) AS n
               FROM (SELECT *, unnest(range(bins)) AS bin FROM ranges) e LEFT JOIN
                    (SELECT split, measure, CASE WHEN hi = lo THEN bins // 2
                            ELSE least((value - lo) * bins // (hi - lo), bins - 1) END AS bin, count(*) AS n
                     FROM lengths JOIN ranges USING (split, measure) GROUP BY ALL) f
               ON e.split = f.split AND e.measure = f.measure AND e.bin = f.bin""",
            *CORPUS, "lengths", "ranges",
        ),
        "vocab": _query("SELECT * FROM vocab", *CORPUS, "rendered", "placed", "vocab"),
        "encode": _query(f"SELECT split, id, {_text_list('ids')} AS input_ids FROM encoded", *TOKENS),
        "encode_shuffled": _query(f"SELECT split, id, {_text_list('ids')} AS input_ids FROM encoded", *TOKENS),
        "completion_mask": _query(
            f"""SELECT split, id, CAST(prompt_length AS INTEGER) AS prompt_length, {_text_list('ids')} AS input_ids,
                {_text_list(_ones('len(ids)'))} AS attention_mask, {_text_list('labels')} AS labels FROM examples""",
            *TOKENS, "examples",
        ),
        "pad_batches": _query(
            f"""SELECT split, id, position, batch_id,
                {_text_list(f"list_concat(ids, {_fill('pad', 0)})")} AS input_ids,
                {_text_list(f"list_concat({_ones('len(ids)')}, {_fill('pad', 0)})")} AS attention_mask,
                {_text_list(f"list_concat(labels, {_fill('pad', fx.IGNORED_LABEL)})")} AS labels FROM batched""",
            *TOKENS, "examples", "positions", "batched",
        ),
        "token_batches": _query(
            """SELECT split, id, position, batch_id, tokens, padded, padded AS labels FROM in_batches""",
            *TOKENS, "examples", "positions", "ranked", "in_batches",
        ),
        "padding_share": _query(
            f"""SELECT split, kind, count(*) AS batches, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(padded - tokens) AS BIGINT) AS padding
                FROM (SELECT split, kind, batch_id, sum(n) AS tokens, max(n) * count(*) AS padded
                      FROM (SELECT split, 'rows' AS kind, (position - 1) // {fx.BATCH_SIZE} AS batch_id, n FROM ranked
                            UNION ALL SELECT split, 'tokens', batch_id, tokens FROM in_batches) GROUP BY ALL) GROUP BY split, kind""",
            *TOKENS, "examples", "positions", "ranked", "in_batches",
        ),
        "pad_prompts": _query(
            f"""SELECT split, id, batch_id, {_text_list(f"list_concat({_fill('pad', 0)}, ids)")} AS input_ids,
                {_text_list(f"list_concat({_fill('pad', 0)}, {_ones('len(ids)')})")} AS attention_mask
                FROM (SELECT *, (position - 1) // {fx.BATCH_SIZE} AS batch_id,
                      max(len(ids)) OVER (PARTITION BY split, (position - 1) // {fx.BATCH_SIZE}) - len(ids) AS pad FROM prompt_ids)""",
            *CORPUS, "rendered", "prompt_placed", "prompt_vocab", "prompt_ids",
        ),
        "mean_output_words": _query(
            f"SELECT name, split, round(avg({_words('prediction')}), 6) AS words FROM runs GROUP BY name, split",
            *CORPUS, "runs",
        ),
        "results_table": _on_runs(
            """SELECT m.split, CAST(CASE WHEN d.name IS NULL THEN 2 ELSE 0 END AS INTEGER) AS section, d.ord, m.name,
                      coalesce(d.label, m.name) AS label, round(m.rouge1, 3) AS rouge1, round(m.rouge2, 3) AS rouge2,
                      round(m."rougeL", 3) AS "rougeL", round(w.words, 1) AS words,
                      d.name IS NOT NULL AND starts_with(m.name, 'qlora_') AND m.rouge1 = max(CASE WHEN d.name IS NOT NULL
                          AND starts_with(m.name, 'qlora_') THEN m.rouge1 END) OVER (PARTITION BY m.split) AS is_best
               FROM metrics m JOIN words w USING (name, split) LEFT JOIN display d ON d.name = m.name""",
            extra=f""", words AS (SELECT name, split, avg({_words('prediction')}) AS words FROM runs GROUP BY ALL),
            display AS (SELECT * FROM (VALUES ('extractive_first_sentence', 'First sentence', CAST(0 AS INTEGER)),
                                              ('qlora_last_sentence', 'Last sentence', 1)) v(name, label, ord))""",
        ),
        "run_comparison": _on_runs(
            "SELECT m.name, m.split, "
            + ", ".join(
                f'round(m.{s}, 6) AS "{s}", round(m.{s} - b.{s}, 6) AS "{s}_gain", round((m.{s} - b.{s}) / nullif(b.{s}, 0), 6) AS "{s}_relative"'
                for s in ALL
            )
            + ", m.n FROM metrics m LEFT JOIN metrics b ON b.split = m.split AND b.name = 'extractive_first_sentence'"
        ),
        "dev_test_gap": _on_runs(
            "SELECT v.name, "
            + ", ".join(
                f'round(v.{s}, 6) AS "{s}_dev", round(t.{s}, 6) AS "{s}_test", round(t.{s} - v.{s}, 6) AS "{s}_gap"' for s in ALL
            )
            + " FROM metrics v JOIN metrics t USING (name) WHERE v.split = 'val' AND t.split = 'test'"
        ),
        "ablation_table": _on_runs(
            """SELECT split, model, CAST(rank AS INTEGER) AS rank,
                      round(max(rouge1) FILTER (variant = 'sentence'), 6) AS sentence_rouge1,
                      round(max(rouge1) FILTER (variant = 'words'), 6) AS words_rouge1,
                      round(max(rouge1) FILTER (variant = 'words') - max(rouge1) FILTER (variant = 'sentence'), 6) AS rouge1_delta
               FROM metrics JOIN (VALUES ('extractive_first_sentence', 'sentence', 'extractive', 0),
                                         ('lead_20_words', 'words', 'extractive', 0),
                                         ('qlora_last_sentence', 'sentence', 'tuned', 8)) f(name, variant, model, rank) USING (name)
               GROUP BY split, model, rank"""
        ),
        "rank_ablation": _query(
            """SELECT w.split, w.name, f.model, f.variant, CAST(f.rank AS INTEGER) AS rank, CAST(f.rank AS BIGINT) * 12 * 9088 AS trainable_params,
                      count(*) AS days, round(max(w.words), 6) AS words
               FROM (SELECT name, split, day, avg(n) AS words
                     FROM (SELECT name, split, ('0x' || left(id, 1))::INTEGER % 4 AS day, """ + _words("prediction") + """ AS n FROM runs)
                     GROUP BY ALL) w
               LEFT JOIN (VALUES ('extractive_first_sentence', 'sentence', 'extractive', 0, 0, 2), ('lead_20_words', 'words', 'extractive', 0, 0, 9),
                                 ('qlora_last_sentence', 'sentence', 'tuned', 16, 0, 2), ('qlora_last_sentence', 'sentence', 'tuned', 8, 2, 9)
                         ) f(name, variant, model, rank, since, until) ON w.name = f.name AND w.day >= f.since AND w.day < f.until
               GROUP BY ALL""",
            *CORPUS, "runs",
        ),
        "papers_scan": _query(
            """SELECT split, count(*) AS n, CAST(sum(len(lines) - 1) AS BIGINT) AS sentences, count(lines) AS summaries
               FROM (SELECT CASE split WHEN 'val' THEN 'validation' ELSE split END AS split, lines FROM raw) GROUP BY split""",
            "raw",
        ),
        "records_round_trip": _query("SELECT split, id, abstract, summary, source FROM records", *CORPUS),
        "predictions_round_trip": _query(
            f"""SELECT split, id, abstract, summary, source, {_first_sentence('abstract')} AS prediction, 'first sentence' AS name
                FROM records""",
            *CORPUS,
        ),
        "metrics_by_file_name": _on_runs(f"SELECT name, split, {rounded}, n FROM metrics"),
        "logged_history": _query("SELECT * FROM history", "history"),
        "logged_histories": _query("SELECT * FROM history", "history"),
        "metric_log_again": _on_runs(
            """SELECT commit, name, split, metric, round(value, 6) AS value FROM (
               SELECT name, split, unnest(['rouge1', 'rouge2', 'rougeL', 'n']) AS metric,
                      unnest([rouge1, rouge2, "rougeL", n::DOUBLE]) AS value FROM metrics), (VALUES ('first'), ('second')) AS c(commit)"""
        ),
        "split_sizes_file": _query("SELECT split, count(*) AS n FROM records GROUP BY split", *CORPUS),
        "predictions_by_file_name": _query(
            f"SELECT name, split, round(avg({_words('prediction')}), 6) AS words FROM runs GROUP BY name, split",
            *CORPUS, "runs",
        ),
        "attach_bucketed": _query(
            f"SELECT split, id, summary, {_first_sentence('abstract')} AS prediction FROM records", *CORPUS
        ),
        "predict_resumed": _query(
            f"SELECT split, id, {_clean(_first_sentence('abstract'))} AS prediction, 'resumed' AS name FROM records", *CORPUS
        ),
        "sketched_profile": _query(
            """SELECT split, measure, probability, count(*) AS n, true AS within
               FROM (SELECT split, measure FROM lengths UNION ALL SELECT split, 'compression_ratio' FROM records),
                    (VALUES (0.05::DOUBLE), (0.5), (0.95)) AS p(probability)
               GROUP BY split, measure, probability""",
            *CORPUS, "lengths",
        ),
        "profile_report": _query(
            f"""SELECT l.split, l.size, l.abstract_median, l.summary_p95, r.ratio_mean, e.examples FROM (
                   SELECT split, count(*) // 2 AS size,
                          round(quantile_cont(value, 0.5) FILTER (measure = 'abstract_tokens'), 6) AS abstract_median,
                          round(quantile_cont(value, 0.95) FILTER (measure = 'summary_tokens'), 6) AS summary_p95
                   FROM lengths GROUP BY split) l
               JOIN (SELECT split, round(avg({_words('summary')}::DOUBLE / greatest({_words('abstract')}, 1)), 6) AS ratio_mean
                     FROM records GROUP BY split) r USING (split)
               JOIN (SELECT split, string_agg(shown, chr(10) ORDER BY place) AS examples FROM (
                         SELECT split, (CASE WHEN length(abstract) > {fx.EXAMPLE_CHARS} THEN substr(abstract, 1, {fx.EXAMPLE_CHARS}) || '…'
                                        ELSE abstract END) || ' => ' || summary AS shown,
                                row_number() OVER (PARTITION BY split ORDER BY sha256('{fx.EXAMPLE_SEED}:' || id), id) AS place
                         FROM records) WHERE place <= {fx.EXAMPLE_ROWS} GROUP BY split) e USING (split)""",
            *CORPUS, "lengths",
        ),
        "tokenizer_factory": """SELECT conv_id, turn,
            array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ' ') AS input_ids FROM conversations""",
        "tokenizer_batched": """SELECT doc_id,
            array_to_string(list_transform(string_split(text, chr(10)), lambda w: length(w) + 1099511627776), ' ') AS input_ids FROM documents""",
        "results_with_deprecated": _results_with_old_run(True),
        "results_without_deprecated": _results_with_old_run(False),
        "metric_long": _on_runs(
            """SELECT name, split, metric, round(value, 6) AS value FROM (
               SELECT name, split, unnest(['rouge1', 'rouge2', 'rougeL', 'n']) AS metric,
                      unnest([rouge1, rouge2, "rougeL", n::DOUBLE]) AS value FROM metrics)"""
        ),
        "loss_curves": _query(
            """SELECT run_id, series, step, value FROM (
               SELECT run_id, step, unnest(['train_loss', 'eval_loss', 'learning_rate']) AS series,
                      unnest([train_loss, eval_loss, learning_rate]) AS value FROM history) WHERE value IS NOT NULL""",
            "history",
        ),
        "logged_steps": _query(f"SELECT * FROM history WHERE step % {fx.LOG_EVERY_STEPS} = 0", "history"),
        "best_checkpoint": _query(
            """SELECT run_id, arg_min(step, (eval_loss, step)) AS step, min(eval_loss) AS eval_loss
               FROM history WHERE eval_loss IS NOT NULL GROUP BY run_id""",
            "history",
        ),
        "retained_checkpoints": _query(
            f"""SELECT run_id, step, coalesce(step = best, false) AS is_best
                FROM (SELECT run_id, step, best, row_number() OVER (PARTITION BY run_id
                          ORDER BY (step = last) DESC, coalesce(step = best, false) DESC, step DESC) AS place
                      FROM (SELECT run_id, step, max(step) OVER (PARTITION BY run_id) AS last,
                                   arg_min(step, (eval_loss, step)) FILTER (eval_loss IS NOT NULL) OVER (PARTITION BY run_id) AS best
                            FROM saved))
                WHERE place <= {fx.CHECKPOINTS_KEPT}""",
            "history", "saved",
        ),
    }
