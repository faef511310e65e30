"""The queries in SQL, as DuckDB reads it, over the same tables."""

from __future__ import annotations

from ..operators import manifest, sft, summaries

SEED = 42
_WS = r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _articles(x: str) -> str:
    pattern = r"(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])"
    return rf"regexp_replace(regexp_replace({x}, '{pattern}', '\1 \2', 'g'), '{pattern}', '\1 \2', 'g')"


def _punctuation(x: str) -> str:
    return rf"regexp_replace({x}, '[!-/:-@\[-`{{-~]', '', 'g')"


def norm_pa(x: str) -> str:
    return collapse(_articles(_punctuation(f"lower({x})")))


def norm_ap(x: str) -> str:
    return collapse(_punctuation(_articles(f"lower({x})")))


def draw(*keys: str, seed: str | int = SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def number(*keys: str, seed: str | int = SEED) -> str:
    return f"('0x' || substr({draw(*keys, seed=seed)}, 1, 8))::BIGINT"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else quoted(p) for i, p in enumerate(parts) if i % 2 or p)


def _first_words(n: str) -> str:
    return f"array_to_string(list_slice(string_split(text, ' '), 1, CAST({n} AS INT)), ' ')"


TOKENS = r"CAST(len(regexp_extract_all({x}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) AS BIGINT)"
_WORD = lambda i: f"coalesce(list_extract(string_split(text, ' '), {i}), '')"
ROLLS = rf"""drawn AS (
    SELECT conv_id AS id, CAST(turn AS INT) AS pos, text, {number('conv_id', 'turn', seed='roll')} % 12 AS kind, {number('conv_id', 'turn', seed='shape')} % 10 AS shape, {number('conv_id', 'turn', seed='golds')} % 6 AS g
    FROM conversations WHERE role = 'assistant'
), told AS (
    SELECT *, CASE WHEN kind < 4 THEN {_first_words('2')} WHEN kind = 4 THEN {_first_words('1')} WHEN kind = 5 THEN {_first_words('3')} ELSE 'wrong ' || {_WORD(5)} END AS said FROM drawn
), rolls AS (
    SELECT id, pos, '<think>' || text || CASE
            WHEN shape < 5 THEN '</think>The answer is **' || said || '**. Done. \boxed{{' || said || '}}'
            WHEN shape = 5 THEN '</think>Done.'
            WHEN shape = 6 THEN '</think>The answer is **' || said || '**'
            WHEN shape = 7 THEN ' The answer is **' || said || '**. \boxed{{' || said || '}}'
            WHEN shape = 8 THEN '</think>So \boxed {{' || said || '}}'
            ELSE '</think>hm</think>\boxed{{{{' || said || '}}}}' END AS text,
        CASE WHEN g = 0 THEN CAST([] AS VARCHAR[]) WHEN g = 1 THEN [{_first_words('2')}] ELSE [{_first_words('2')}, {_WORD(3)}] END AS golds
    FROM told
)"""
_FOUND = strip(f"regexp_replace({strip(r'''regexp_extract(replace(text, '*', ''), '(?is)^.*the answer is(.*)$', 1)''')}, '^:+', '')")
AFTER_LAST = "nullif(" + strip(rf"regexp_extract({_FOUND}, '(?s)\A(.*?)(?:\n|\.(?:{_WS}|\z)|\z)', 1)") + ", '')"
_INNER = r"(?:[^{}]|\{[^{}]*\})*"  # braces within a box, one level deep


def last_boxed(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '(?s).*(\\boxed[^{{}}]*\{{{_INNER}\}})', 1), '')"


def unboxed(x: str) -> str:
    return rf"CASE WHEN starts_with({x}, '\boxed ') THEN substr({x}, 8) WHEN starts_with({x}, '\boxed{{') AND ends_with({x}, '}}') THEN substr({x}, 8, length({x}) - 8) ELSE {x} END"


_LAST = "string_split(text, '</think>')[-1]"
_REST = f"replace({_LAST}, '*', '')"
THINK = f"CASE WHEN contains(text, '</think>') THEN {unboxed(last_boxed(strip(_REST)))} END"
_LOWER = r"replace(lower(text), '\boxed{}', '')"
_PLAIN = f"replace({_LOWER}, '*', '')"
_AFTER_MARK = strip(f"string_split({_PLAIN}, 'the answer is')[-1]")
_SAID = strip(rf"regexp_replace({_AFTER_MARK}, '^\.+|\.+$', '', 'g')")
JUDGED = rf"""CASE WHEN contains({_LOWER}, '\boxed ') THEN string_split(string_split({_LOWER}, '\boxed ')[-1], '$')[1]
    WHEN {last_boxed(_LOWER)} IS NOT NULL THEN regexp_extract({_LOWER}, '(?s).*\\boxed\{{({_INNER})\}}', 1) WHEN contains({_PLAIN}, 'the answer is') THEN {_SAID} ELSE 'boxed extraction failed' END"""


def _f1(p: str, g: str) -> str:
    pw, gw = (f"list_filter(string_split({x}, ' '), lambda w: w <> '')" for x in (p, g))
    shared = f"list_sum(list_transform(list_distinct({pw}), lambda w: least(len(list_filter({pw}, lambda y: y = w)), len(list_filter({gw}, lambda y: y = w)))))"
    pr, rc = f"({shared} / len({pw})::DOUBLE)", f"({shared} / len({gw})::DOUBLE)"
    return f"(CASE WHEN coalesce({shared}, 0) > 0 THEN 2 * {pr} * {rc} / ({pr} + {rc}) ELSE 0.0::DOUBLE END)"


def _scored(name: str, pred: str, norm) -> str:
    """Per rollout and gold: normalised p and g."""
    return f"""pairs AS (SELECT id, pos, pred, {norm('pred')} AS p, unnest(CASE WHEN len(golds) = 0 THEN [NULL] ELSE golds END) AS gold FROM (SELECT *, {pred} AS pred FROM rolls)),
    normed AS (SELECT *, {norm('gold')} AS g FROM pairs), {name} AS (SELECT id, pos, pred, p, g, {_f1('p', 'g')} AS f FROM normed)"""


AFTER_FIRST = strip("""regexp_extract(text, '(?is)the answer is(.*)$', 1)""")


def _covered(pred: str) -> str:
    return f"""WITH {ROLLS}, {_scored('s', pred, norm_pa)}, covered AS (
    SELECT id, pos, CASE WHEN coalesce(any_value(pred), '') = '' THEN 0.0::DOUBLE ELSE coalesce(max(CASE WHEN contains(g, p) THEN 1.0::DOUBLE ELSE 0.0 END), 0.0) END AS cem_score,
        CASE WHEN coalesce(any_value(pred), '') = '' THEN 0.0::DOUBLE ELSE coalesce(max(f), 0.0) END AS f1_score
    FROM s GROUP BY id, pos
), per AS (
    SELECT id, avg(cem_score) AS avg_cem_score, sum(cem_score) AS total_cem_score, avg(f1_score) AS avg_f1_score, count(*) FILTER (WHERE f1_score > 0.75) AS high_f1_count FROM covered GROUP BY id
)"""


COVERED = _covered(AFTER_LAST)
_EITHER = "CASE WHEN contains(g, p) OR contains(p, g) THEN 1 ELSE 0 END"
JUDGE = f"""WITH {ROLLS}, {_scored('s', JUDGED, norm_pa)}, judged AS (
    SELECT id, pos, any_value(pred) AS reason, CAST(CASE WHEN any_value(pred) = 'boxed extraction failed' THEN 0 ELSE coalesce(max({_EITHER}), 0) END AS INT) AS is_correct FROM s GROUP BY id, pos
), per AS (SELECT id, avg(is_correct) AS avg_acc, max(is_correct) > 0 AS any_correct FROM judged GROUP BY id)"""
RECORDS = f"""WITH {ROLLS}, {_scored('s', THINK, norm_ap)}, scored AS (
    SELECT id, pos, any_value(pred) AS extracted_answer,
        CAST(CASE WHEN coalesce(any_value(pred), '') = '' THEN 0 ELSE max({_EITHER}) END AS INT) AS sub_em,
        CAST(CASE WHEN coalesce(any_value(pred), '') = '' THEN 0 ELSE max(CASE WHEN p = g THEN 1 ELSE 0 END) END AS INT) AS em,
        CASE WHEN coalesce(any_value(pred), '') = '' THEN 0.0 ELSE coalesce(round_even(max(f), 4), 0.0) END AS f1
    FROM s GROUP BY id, pos
), heads AS (SELECT id, max(golds) AS answers FROM rolls GROUP BY id),
rows AS (
    SELECT scored.id AS source_index, pos, row_number() OVER (PARTITION BY scored.id ORDER BY pos) - 1 AS traj_pos, extracted_answer, sub_em, em, f1, rolls.text,
        'What is ' || scored.id || '?' AS input, 'Passage 1:' || chr(10) || coalesce(answers[1], '') AS context, answers, CAST(4096 * pow(2, scored.id % 4) AS INT) AS length
    FROM scored JOIN rolls USING (id, pos) JOIN heads ON heads.id = scored.id
)"""
CORPUS = "corpus AS (SELECT row_number() OVER (ORDER BY text) - 1 AS doc_id, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL))"
OWN = f"""own AS (
    SELECT qid, query, pos, documents.text FROM (
        SELECT item_id AS qid, text AS query, pos, {number('item_id', 'pos', seed='own')} % (SELECT count(*) FROM documents) AS doc FROM benchmark, unnest(range(4)) AS r(pos)
    ) JOIN documents ON documents.doc_id = doc
)"""
#: The question's own passages, then fillers drawn by number, repeats and own ones left out.
CANDIDATES = f"""WITH {CORPUS}, {OWN}, core AS (SELECT DISTINCT qid, doc_id FROM own JOIN corpus USING (text)),
core_ranked AS (SELECT qid, doc_id, 0 AS tier, row_number() OVER (PARTITION BY qid ORDER BY {draw('qid', 'doc_id')}, doc_id) AS r FROM core),
tries AS (SELECT qid, i, {number('qid', 'i')} % (SELECT count(*) FROM corpus) AS doc_id FROM (SELECT DISTINCT qid FROM own), unnest(range(112)) AS t(i)),
fillers AS (
    SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY i, doc_id) AS r
    FROM (SELECT qid, doc_id, min(i) AS i FROM tries WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM core) GROUP BY qid, doc_id)
), candidates AS (SELECT * FROM core_ranked UNION ALL SELECT qid, doc_id, 2 AS tier, r FROM fillers WHERE r <= 60),
chosen AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, r, doc_id) - 1 AS pos FROM candidates)"""
STEPS = "steps AS (SELECT CAST(day(ts) AS BIGINT) AS step, event_type AS cls, user_id AS input, CAST(CAST(floor(value) AS BIGINT) % 2 AS DOUBLE) AS score FROM events)"
PER_INPUT = f"WITH {STEPS}, per AS (SELECT step, cls, input, count(*) AS n, sum(score) AS total FROM steps GROUP BY ALL)"
METRICS = f"""WITH {STEPS}, metrics AS (
    SELECT cls AS run, step, avg(score) AS mean, CAST(count(*) FILTER (WHERE score = 1 AND input % 2 = 0) AS DOUBLE) AS "right", CAST(count(*) FILTER (WHERE score = 0 AND input % 2 = 0) AS DOUBLE) AS wrong FROM steps GROUP BY ALL
)"""
PASSAGE_LIST = "passages AS (SELECT qid, any_value(query) AS query, list(text ORDER BY pos) AS passages FROM own GROUP BY qid)"
JUDGED_DOCS = "judged AS (SELECT labels.*, n_chars, n_chars * 8 AS length, lang, source FROM labels JOIN documents USING (doc_id))"
MESSAGES = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id"
ERRORS = """chats AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id),
errors AS (
    SELECT conv_id, list_filter(list_transform(range(len(roles)), lambda i: CASE
            WHEN roles[i + 1] IS NULL OR texts[i + 1] IS NULL THEN 'message[' || i || '] missing ''role'' or ''content'''
            WHEN texts[i + 1] = '' THEN 'message[' || i || '] has empty content' END)
        || [CASE WHEN roles[-1] IS DISTINCT FROM 'assistant' THEN 'last message role must be ''assistant'', got ''' || coalesce(roles[-1], 'None') || '''' END], lambda e: e IS NOT NULL) AS e
    FROM chats
)"""
DECOYS = f"""questions AS (SELECT item_id AS qid, text AS query, row_number() OVER (ORDER BY item_id) - 1 AS number FROM benchmark),
tries AS (SELECT qid, query, i, {number('qid', 'i')} % (SELECT count(*) FROM questions) AS number FROM questions, unnest(range(__DRAWS__)) AS t(i)),
met AS (
    SELECT f.qid AS qid, o.query AS otext, row_number() OVER (PARTITION BY f.qid ORDER BY i) AS r
    FROM (SELECT qid, query, number, min(i) AS i FROM tries GROUP BY ALL) f JOIN questions o USING (number)
    WHERE o.qid <> f.qid AND o.query <> f.query
)"""
_DRAWS = {8: 44, 16: 56}


def _chains(n: int, hops: int = 4) -> str:
    one = lambda h: f"substr({draw('qid', 'chain', str(h))}, 1, 8)"
    ids = ", ".join(one(h) for h in range(hops))
    return f"""WITH {DECOYS.replace('__DRAWS__', str(_DRAWS[16]))}, decoys AS (SELECT qid, list(otext ORDER BY r) AS d FROM met WHERE r <= 16 GROUP BY qid),
    chains AS (SELECT qid, query, chain, [{ids}] AS ids, CASE WHEN chain = 0 THEN query ELSE d[chain + 1] END AS target FROM questions JOIN decoys USING (qid), unnest(range({n})) AS c(chain)),
    pairs AS (SELECT *, list_transform(range({hops}), lambda i: '{{"' || ids[i + 1] || '": "' || CASE WHEN i = {hops - 1} THEN target ELSE ids[i + 2] END || '"}}') AS pairs FROM chains)"""


_SHUFFLED = f"SELECT doc_id, row_number() OVER (ORDER BY {draw('doc_id')} || ':' || doc_id) - 1 AS place FROM documents"


def _bins(bins: tuple, length: str = "length") -> str:
    return "CASE " + " ".join(f"WHEN {length} < {top} THEN '{name}'" if top else f"ELSE '{name}'" for top, name in bins) + " END"


_STORY = ((16384, "0-16k"), (32768, "16k-32k"), (49152, "32k-48k"), (65536, "48k-64k"))
_CHOICE = ((16384, "0-16k"), (32768, "16k-32k"), (65536, "32k-64k"), (None, ">64k"))


def _accuracy(bins: tuple, empty: str) -> str:
    labels = ", ".join(f"('{b[1]}')" for b in bins)
    fill = (lambda c: f"coalesce({c}, 0)") if empty != "NULL" else (lambda c: c)
    return f"""WITH {JUDGED_DOCS}, stats AS (SELECT {_bins(bins)} AS bin, count(*) AS total, CAST(sum(quality) AS BIGINT) AS correct FROM judged GROUP BY 1)
    SELECT l.bin, {fill('total')} AS total, {fill('correct')} AS correct, coalesce(round_even(correct / total, 6), {empty}) AS accuracy FROM (VALUES {labels}) l(bin) LEFT JOIN stats USING (bin)"""


def _wide(bin_: str) -> str:
    return f"{PER_INPUT} SELECT step, cls, {', '.join(f'count(*) FILTER (WHERE {bin_} = {i}) AS bin_{i}' for i in range(5))} FROM per GROUP BY step, cls"


_HALVES = f"{RECORDS}, r AS (SELECT 'chat' AS dataset, length, source_index, traj_pos, CASE WHEN traj_pos = 0 THEN 'existing' ELSE 'incremental' END AS origin FROM rows)"
_SEGMENTS = r"""docs AS (SELECT doc_id AS idx, text, regexp_extract_all(text, '[^\n.?]*[\n.?]|[^\n.?]+') AS segs FROM documents),
segments AS (SELECT idx, pos, segs[pos + 1] AS segment, regexp_matches(segs[pos + 1], '[\n.?]\z') AS stops FROM docs, unnest(range(len(segs))) AS p(pos))"""
_INSERTED = f"""WITH {_SEGMENTS}, pairs AS (
    SELECT doc_id AS idx, '{{"' || substr({draw('doc_id', 'i')}, 1, 8) || '": "' || substr({draw('doc_id', 'i', seed='end')}, 1, 8) || '"}}' AS pair FROM documents, unnest(range(8)) AS t(i)
), turned AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY {draw('idx', 'pair')}, pair) AS turn FROM pairs),
stopped AS (SELECT *, CASE WHEN stops THEN row_number() OVER (PARTITION BY idx, stops ORDER BY {draw('idx', "'stop'", 'pos')}, pos) END AS turn, count(*) FILTER (WHERE stops) OVER (PARTITION BY idx) AS n FROM segments)
SELECT s.idx AS "index", md5(string_agg(segment || CASE WHEN pair IS NULL THEN '' ELSE CASE WHEN right(segment, 1) = chr(10) THEN '' ELSE ' ' END || pair || '.' END, '' ORDER BY pos)) AS digest
FROM stopped s LEFT JOIN turned t ON t.idx = s.idx AND t.turn = s.turn WHERE n >= 8 GROUP BY s.idx"""
_TREE_ID = lambda i: f"substr({draw('item_id', i)}, 1, 8)"

SQL: dict[str, str] = {
    "v1_validate_rows": f"WITH {ERRORS} SELECT conv_id, CAST(len(e) AS BIGINT) AS n_errors, coalesce(e[1], '') AS first_error FROM errors",
    "a22_error_counts": rf"WITH {ERRORS} SELECT regexp_replace(x, '\[\d+\]', '', 'g') AS rule, count(*) AS n FROM (SELECT unnest(e) AS x FROM errors) GROUP BY 1",
    "f1_normalize_punctuation_first": f"SELECT doc_id, md5({norm_pa('text')}) AS digest FROM documents",
    "f2_normalize_articles_first": f"SELECT doc_id, md5({norm_ap('text')}) AS digest FROM documents",
    "p11_collapse_spaces": f"SELECT doc_id, md5({collapse('text')}) AS digest FROM documents",
    "f3_answer_after_first": f"WITH {ROLLS} SELECT id, pos, {AFTER_FIRST} AS answer FROM rolls",
    "f4_answer_after_last": f"WITH {ROLLS} SELECT id, pos, {AFTER_LAST} AS answer FROM rolls",
    "f10_last_boxed": f"WITH {ROLLS} SELECT id, pos, {last_boxed('text')} AS boxed FROM rolls",
    "f14_think_answer": f"WITH {ROLLS} SELECT id, pos, {THINK} AS answer FROM rolls",
    "f15_judge_answer": f"{JUDGE} SELECT id, pos, reason, is_correct FROM judged",
    "f17_clean_trace": f"""WITH {ROLLS}, cut AS (SELECT id, pos, {strip(_LAST)} AS after, {strip(f"substr(text, 1, length(text) - length({_LAST}) - 8)")} AS before FROM rolls WHERE contains(text, '</think>'))
        SELECT id, pos, md5('<think>' || before || '</think>' || coalesce({unboxed(last_boxed('after'))}, after)) AS digest FROM cut""",
    "f18_option_letter": rf"""WITH {ROLLS}, said AS (SELECT id, pos, text || [chr(10) || 'Final answer: (b)', chr(10) || 'Answer: C', chr(10) || 'Answer: **D**.', chr(10) || 'Answer: (A)', chr(10) || 'The correct answer is (B)', chr(10) || '\boxed{{(c) so}}', ''][(id + pos) % 7 + 1] AS s FROM rolls),
        o AS (SELECT id, pos, coalesce(nullif(regexp_extract(s, '(?i)final answer:\s*\(([A-Za-z])\)', 1), ''), nullif(regexp_extract(s, '(?i)answer:\s*([A-Za-z])', 1), ''), nullif(regexp_extract(s, '(?i)answer:\s*\*\*([A-Za-z])\*\*\.?', 1), ''), nullif(regexp_extract(s, '(?i)answer:\s*\(([A-Za-z])\)', 1), '')) AS standard,
            upper(nullif(regexp_extract(regexp_extract(s, '(?s).*(boxed[^{{}}]*\{{{_INNER}\}})', 1), '\((\w)\)', 1), '')) AS boxed,
            coalesce(nullif(regexp_extract(replace(s, '*', ''), 'The correct answer is \(([A-D])\)', 1), ''), nullif(regexp_extract(replace(s, '*', ''), 'The correct answer is ([A-D])', 1), '')) AS original FROM said)
        SELECT id, pos, standard, boxed, coalesce(boxed, standard) AS mix, original FROM o""",
    "p24_before_marker": f"SELECT doc_id, md5({strip('''string_split(text, '. ')[1]''')}) AS digest FROM documents",
    "p9_fill_prompt": f"{RECORDS} SELECT DISTINCT source_index, {filled(sft.READ, context='context', input='input')} AS prompt FROM rows",
    "p10_numbered_passages": f"WITH {OWN} SELECT qid, md5(string_agg('Passage ' || (pos + 1) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY pos)) AS digest FROM own GROUP BY qid",
    "p26_size_label": """WITH x AS (SELECT doc_id, n_chars * 37 AS v FROM documents)
        SELECT doc_id, CASE WHEN v > 990000 THEN CAST(round_even(v / 1000000, 0) AS BIGINT) || 'M' WHEN v <= 10000 THEN CASE WHEN v > 5000 THEN '10K' ELSE '1K' END
            WHEN round_even(v / 1000, 0) = 128 THEN '128K' ELSE CAST(round_even(v / 10000, 0) AS BIGINT) * 10 || 'K' END AS label, CAST(round_even(v / 1000, 0) AS BIGINT) || 'K' AS thousands FROM x""",
    "f20_token_count": f"SELECT doc_id, {TOKENS.format(x='text')} AS n_tokens FROM documents",
    "f5_f7_f8_rewards": f"""WITH {ROLLS}, {_scored('s', AFTER_LAST, norm_ap)}
        SELECT id, pos, CAST(CASE WHEN coalesce(any_value(pred), '') = '' THEN 0 ELSE max({_EITHER}) END AS INT) AS sub_em, CAST(CASE WHEN coalesce(any_value(pred), '') = '' THEN 0 ELSE max(CASE WHEN p = g THEN 1 ELSE 0 END) END AS INT) AS em,
            CASE WHEN coalesce(any_value(pred), '') = '' THEN 0.0 ELSE coalesce(max(f), 0.0) END AS f1 FROM s GROUP BY id, pos""",
    "f6_covered_match": f"{_covered(AFTER_FIRST)} SELECT * FROM covered",
    "f9_judge_match": f"WITH {ROLLS}, {_scored('s', THINK, norm_pa)} SELECT id, pos, CAST(max({_EITHER}) AS INT) AS hit FROM s GROUP BY id, pos",
    "f19_any_judge": "SELECT doc_id, coalesce(quality, 0) > 0 OR coalesce(toxic, 0) > 0 AS any_yes FROM labels",
    "a2_question_stats": f"{COVERED} SELECT id, avg_cem_score, total_cem_score, round_even(avg_f1_score, 6) AS avg_f1_score, high_f1_count FROM per",
    "a3_score_histogram": f"{COVERED} SELECT r.value, count(per.id) AS n FROM (SELECT unnest(range(9)) AS value) r LEFT JOIN per ON CAST(total_cem_score AS BIGINT) = r.value GROUP BY 1",
    "p21_bands": f"{COVERED} SELECT id, CASE WHEN total_cem_score = 0 THEN 'all_wrong' WHEN total_cem_score BETWEEN 1 AND 6 THEN 'mixed' ELSE 'none' END AS band, total_cem_score NOT IN (0, 8) AS not_extreme FROM per",
    "u3_selected_questions": f"""{COVERED} SELECT id FROM per WHERE total_cem_score BETWEEN 1 AND 6 UNION ALL
        SELECT id FROM per JOIN (SELECT id, sum(pos % 2) AS second FROM covered GROUP BY id) USING (id) WHERE total_cem_score = 0 AND second NOT IN (0, 8)""",
    "a4_pass_rate": f"{RECORDS} SELECT source_index AS id, CAST(sum(sub_em) AS BIGINT) AS num_correct, round_even(round_even(sum(sub_em) / count(*), 4), 3) AS pass_rate FROM rows GROUP BY 1",
    "a5_file_summary": f"{RECORDS}, per AS (SELECT source_index, max(sub_em) AS hit, sum(f1) AS f, count(*) AS n FROM rows GROUP BY 1) SELECT count(*) AS questions, CAST(sum(hit) AS BIGINT) AS any_correct, round_even(sum(hit) / count(*), 6) AS any_correct_rate, round_even(sum(f) / sum(n), 6) AS avg_f1 FROM per",
    "a6_judge_summary": f"{JUDGE} SELECT round_even(avg(avg_acc), 6) AS macro_avg_acc, round_even(avg(CAST(any_correct AS INT)), 6) AS micro_any_correct, count(*) AS num_samples FROM per",
    "a7_accuracy_histogram": f"{JUDGE} SELECT round_even(avg_acc, 6) AS avg_acc, count(*) AS n FROM per GROUP BY 1",
    "p22_not_perfect": f"{JUDGE} SELECT id FROM per WHERE avg_acc < 1",
    "p14_convert_rows": f"{RECORDS} SELECT source_index, CAST(traj_pos AS INT) AS traj_pos, sub_em, em, extracted_answer, md5({filled(sft.READ, context='context', input='input')}) AS prompt, md5(text) AS reply FROM rows",
    "a8_best_of_n": f"{RECORDS} SELECT source_index, length, CAST(traj_pos AS INT) AS traj_pos, extracted_answer FROM rows WHERE sub_em = 1 QUALIFY row_number() OVER (PARTITION BY length, source_index ORDER BY f1 DESC, traj_pos) = 1",
    "p27_rl_rows": f"{RECORDS} SELECT DISTINCT input AS question, answers[1] AS answer, md5({filled(sft.REASON_WITH_MARKERS, context='context', input='input')}) AS prompt FROM rows",
    "u2_merged_rows": f"{_HALVES} SELECT dataset, length, source_index, CAST(traj_pos AS INT) AS traj_pos, origin FROM r",
    "a20_merge_counts": f"""{_HALVES}, c AS (SELECT dataset, length, count(*) FILTER (WHERE origin = 'existing') AS existing, count(*) FILTER (WHERE origin = 'incremental') AS incremental FROM r GROUP BY ALL),
        b AS (SELECT * FROM c WHERE existing > 0 AND incremental > 0)
        SELECT dataset, length, existing, incremental, existing + incremental AS merged FROM b UNION ALL SELECT 'total', 0, CAST(sum(existing) AS BIGINT), CAST(sum(incremental) AS BIGINT), CAST(sum(existing + incremental) AS BIGINT) FROM b""",
    "p16_p20_summary_rows": rf"""WITH d AS (SELECT a.doc_id, a.text, 'User: ' || a.text || chr(10) || chr(10) || 'Q: ' || CASE WHEN a.doc_id % 2 = 0 THEN 'Write a summary' ELSE 'What is it?' END || chr(10) || chr(10) || 'Assistant:' AS question, b.text AS answer, nullif(a.n_chars, 0) AS words FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
        r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(question, '^User: ', ''), '(\n\n|\n|)Assistant:\z', ''), '{_WS}+\z', '') AS request FROM d),
        k AS (SELECT *, {TOKENS.format(x='request')} AS input_tokens, coalesce({TOKENS.format(x='answer')}, 0) AS output_tokens FROM r)
        SELECT doc_id, CASE WHEN NOT ({" OR ".join(f"contains(lower(right(question, 300)), '{w}')" for w in summaries.KEYWORDS)}) THEN 'no_keyword' WHEN input_tokens < 4096 THEN 'input_too_short' WHEN output_tokens < 20 THEN 'output_too_short' ELSE 'kept' END AS reason,
            md5(request) AS request, input_tokens, output_tokens, words FROM k""",
    "a1_corpus_distinct": f"WITH {CORPUS} SELECT doc_id, md5(text) AS digest FROM corpus",
    "j1_dictionary_encode": f"WITH {CORPUS}, {OWN} SELECT qid, string_agg(CAST(corpus.doc_id AS VARCHAR), ',' ORDER BY pos) AS context FROM own JOIN corpus USING (text) GROUP BY qid",
    "j2_texts_by_id": f"WITH {OWN} SELECT qid, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM own GROUP BY qid",
    "p8_flat_questions": f"WITH {OWN} SELECT qid AS id, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest, 'hard' AS level FROM own GROUP BY qid",
    "j3_listed_questions": "SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "j6_containing_passages": f"""WITH {OWN}, hits AS (SELECT qid, pos, text, unnest(list_slice(string_split(query, ' '), 1, 2)) AS f, unnest([1, 2]) AS k FROM own)
        SELECT o.qid, coalesce(string_agg(CASE WHEN contains(h.text, h.f) THEN CAST(h.pos AS VARCHAR) END, ',' ORDER BY h.pos, k), '') AS support FROM (SELECT DISTINCT qid FROM own) o LEFT JOIN hits h USING (qid) GROUP BY o.qid""",
    "o1_shuffled_slice": f'SELECT doc_id, place - 50 AS "index", place AS source_index FROM ({_SHUFFLED}) WHERE place >= 50 AND place < 150',
    "p12_slice": "SELECT doc_id FROM documents WHERE doc_id >= 100",
    "p13_chunks": "SELECT doc_id, CAST(floor(doc_id / ceil((SELECT count(*) FROM documents) / 7)) AS INT) AS node FROM documents",
    "o16_length_mix": f"""WITH s AS ({_SHUFFLED}), n AS (SELECT count(*) AS n FROM documents), k AS (SELECT CAST(floor(0.1 * n) AS BIGINT) AS a, CAST(floor(0.8 * n) AS BIGINT) AS b FROM n)
        SELECT doc_id AS "index", CASE WHEN place < a THEN 4096 WHEN place < 2 * a THEN 8192 ELSE 16384 END AS length FROM s, k WHERE place < 2 * a + b""",
    "o10_decoy_questions": f"WITH {DECOYS.replace('__DRAWS__', str(_DRAWS[8]))} SELECT qid, md5(string_agg(otext, '|' ORDER BY r)) AS digest FROM met WHERE r <= 8 GROUP BY qid",
    "j4_filler_passages": f"{CANDIDATES} SELECT qid, doc_id, tier, CAST(r AS INT) AS r FROM candidates",
    "o2_budget_fit": f"""{CANDIDATES}, running AS (
            SELECT qid, pos, sum({TOKENS.format(x='text')} + 4) OVER (PARTITION BY qid ORDER BY pos) AS total, count(*) OVER (PARTITION BY qid) AS n FROM chosen JOIN corpus USING (doc_id)
        ) SELECT qid, CAST(coalesce(max(pos + 1) FILTER (WHERE ok), 0) AS INT) AS num_docs, CAST(coalesce(max(total) FILTER (WHERE ok), 0) AS BIGINT) AS tokens, coalesce(bool_or(ok), false) AS fits
        FROM (SELECT *, total + 1024 <= 16384 AND ((pos + 1) % 10 = 0 OR pos + 1 = n) AS ok FROM running) GROUP BY qid""",
    "o5_shuffled_context": f"{CANDIDATES} SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY {draw('qid', 'doc_id')}, doc_id) AS context FROM chosen WHERE pos < 20 GROUP BY qid",
    "o6_o7_core_in_the_middle": f"""{CANDIDATES}, few AS (SELECT qid, doc_id, tier = 0 AS own, row_number() OVER (PARTITION BY qid, tier = 0 ORDER BY {draw('qid', 'doc_id')}, doc_id) AS rank FROM chosen WHERE pos < 60),
        sizes AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE own) AS k FROM few GROUP BY qid),
        throws AS (SELECT qid, n, k, i, sqrt(-2 * ln(({number('qid', 'i', seed='42a')} + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * (({number('qid', 'i', seed='42b')} + 0.5::DOUBLE) / 4294967296)) * 0.3::DOUBLE AS x FROM (SELECT qid, n, k, unnest(range(50 * k)) AS i FROM sizes)),
        drawn AS (SELECT qid, CAST(floor((greatest(-0.95::DOUBLE, least(0.95::DOUBLE, x)) + 0.95::DOUBLE) / 1.9::DOUBLE * (n - 1)) AS BIGINT) AS slot, min(i) AS turn FROM throws GROUP BY ALL),
        free AS (SELECT s.qid, s.slot, 50 * k + {number('s.qid', 's.slot', seed='42c')} AS turn FROM (SELECT qid, k, unnest(range(n)) AS slot FROM sizes) s LEFT JOIN drawn d ON d.qid = s.qid AND d.slot = s.slot WHERE d.slot IS NULL),
        placed AS (SELECT qid, slot, row_number() OVER (PARTITION BY qid ORDER BY turn, slot) <= k AS own FROM (SELECT qid, slot, turn FROM drawn UNION ALL SELECT qid, slot, turn FROM free) JOIN sizes USING (qid)),
        slots AS (SELECT *, row_number() OVER (PARTITION BY qid, own ORDER BY slot) AS rank FROM placed)
        SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY slot) AS context FROM few JOIN slots USING (qid, own, rank) GROUP BY qid""",
    "o11_chain_pairs": f"""{_chains(8)} SELECT qid AS "index", CAST(chain AS INT) AS chain, ids[1] AS head, md5(array_to_string(pairs, '|')) AS digest FROM pairs""",
    "o14_chain_walk": 'SELECT item_id AS "index", text AS reached FROM benchmark',
    "o12_insert_pairs": _INSERTED,
    "o12_too_few_stoppers": f'WITH {_SEGMENTS} SELECT docs.idx AS "index", count(pos) FILTER (WHERE stops) AS stoppers, 8 AS pairs FROM docs LEFT JOIN segments USING (idx) GROUP BY docs.idx HAVING count(pos) FILTER (WHERE stops) < 8',
    "o13_identifiers": f"SELECT item_id AS qid, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) AS long_id, substr(d, 1, 8) AS short_id FROM (SELECT item_id, {draw('item_id')} AS d FROM benchmark)",
    "o15_tree_pairs": f"""WITH n AS (SELECT item_id AS qid, text, i, {_TREE_ID('i')} AS node, {_TREE_ID('2 * i + 1')} AS l, {_TREE_ID('2 * i + 2')} AS r, {draw('item_id', 'i')} AS d, md5(concat_ws(':', '{SEED}end', item_id, i)) AS e FROM benchmark, unnest(range(7)) AS t(i)),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d) AS k FROM n WHERE i >= 3)
        SELECT qid, CAST(2 * i + 1 AS INT) AS pos, '{{"' || node || '": "' || l || '"}}' AS pair FROM n WHERE i < 3 UNION ALL SELECT qid, CAST(2 * i + 2 AS INT), '{{"' || node || '": "' || r || '"}}' FROM n WHERE i < 3
        UNION ALL SELECT qid, CAST(7 + i AS INT), '{{"' || node || '": "' || CASE WHEN k = 1 THEN text ELSE substr(e, 1, 8) || '-' || substr(e, 9, 4) || '-' || substr(e, 13, 4) || '-' || substr(e, 17, 4) || '-' || substr(e, 21, 12) END || '"}}' FROM leaves""",
    "j8_zipped": "SELECT doc_id AS row_idx, lang, source FROM documents",
    "j9_first_reasoning": f'{RECORDS} SELECT source_index AS "index", md5(text) AS digest FROM rows WHERE traj_pos = 0',
    "j10_differences": "SELECT doc_id AS row_idx, quality AS left_value, toxic AS right_value FROM labels WHERE quality IS DISTINCT FROM toxic",
    "j14_paired_files": f"{RECORDS} SELECT 'chat' AS dataset, length, min(CAST(source_index AS VARCHAR)) AS existing_file, min(CAST(source_index AS VARCHAR)) AS incremental_file FROM rows WHERE length > 4096 GROUP BY length",
    "a9_length_stats": f"WITH k AS (SELECT {TOKENS.format(x='text')} AS n FROM documents) SELECT min(n) AS min, max(n) AS max, round_even(avg(n), 6) AS mean, count(*) AS n FROM k",
    "a10_token_report": "SELECT count(n_chars) AS n, min(n_chars) AS min, max(n_chars) AS max, round_even(avg(n_chars), 4) AS mean, round_even(stddev_samp(n_chars), 4) AS std, "
    + ", ".join(f"round_even(quantile_cont(n_chars, {q}), 4) AS {name}" for q, name in ((0.5, "median"), (0.25, "p25"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))
    + " FROM documents",
    "a10_token_ranges": "SELECT CAST(CASE WHEN n_chars >= 8000 THEN 8000 WHEN n_chars >= 4000 THEN 4000 WHEN n_chars >= 2000 THEN 2000 WHEN n_chars >= 1000 THEN 1000 ELSE 0 END AS BIGINT) AS range_start, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY 1",
    "a11_accuracy_by_bin": _accuracy(_STORY, "NULL"),
    "j12_choice_bins": _accuracy(_CHOICE, "0.0"),
    "a12_accuracy_by_group": f"""WITH {JUDGED_DOCS} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(toxic) = 0 THEN 'toxic' ELSE 'overall' END AS grouping,
        CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source WHEN grouping(toxic) = 0 THEN CAST(toxic AS VARCHAR) ELSE '' END AS value, CAST(sum(quality) AS BIGINT) AS "right", count(*) AS n FROM judged GROUP BY GROUPING SETS ((lang), (source), (toxic), ())""",
    "a13_step_scores": f"WITH {STEPS}, per AS (SELECT step, cls, input, count(score) AS n, sum(score) AS total, min(score) AS low, max(score) AS high FROM steps GROUP BY ALL) SELECT step, cls, round_even(sum(total) / sum(n), 6) AS avg_score, count(*) AS inputs, count(*) FILTER (WHERE low < high) AS varied_inputs FROM per GROUP BY ALL",
    "a14_occurrence_bins": _wide("least(n, 4)"),
    "a15_score_bins": _wide("round_even(total, 0)"),
    "a16_fixed_reward": f'{METRICS} SELECT run, step, round_even((mean * (512 - wrong - "right") + "right") / 512, 6) AS reward FROM metrics',
    "a17_mean_series": f'{METRICS} SELECT run, step, ("right" + wrong) / 2 AS value FROM metrics',
    "a18_joined_stages": f'{METRICS}, s AS (SELECT step, sum("right") AS value FROM metrics GROUP BY step) SELECT 0 AS stage, step - 1 AS x, value FROM s WHERE step BETWEEN 1 AND 10 UNION ALL SELECT 1, step - 5 + 10, value FROM s WHERE step BETWEEN 5 AND 20',
    "a19_depth_pivot": f"WITH {STEPS} SELECT input % 5 AS depth, {', '.join(f'round_even(avg(score) FILTER (WHERE step % 3 = {i}), 6) AS len_{i * 1000}' for i in range(3))} FROM steps GROUP BY 1",
    "a19_unpivot": f"WITH {STEPS} SELECT step, CAST(1 AS BIGINT) AS context_length, sum(score) AS score FROM steps GROUP BY step UNION ALL SELECT step, 2, CAST(count(*) AS DOUBLE) FROM steps GROUP BY step",
    "a21_manifest_status": f"""{RECORDS}, m AS (SELECT DISTINCT length, [{', '.join(f"'{s}'" for s in manifest.STAGES)}][source_index % 5 + 1] AS stage, source_index AS made FROM rows),
        l AS (SELECT length, stage, max(made) AS made FROM m GROUP BY ALL), d AS (SELECT length, bool_or(stage = 'merged') AS merged, arg_max(stage, made) AS current_stage, max(made) FILTER (WHERE stage = 'filtered') AS samples FROM l GROUP BY length)
        SELECT 'chat' AS dataset, e.length, CASE WHEN merged THEN 'complete' WHEN d.length IS NOT NULL THEN 'in_progress' ELSE 'pending' END AS status, coalesce(current_stage, '-') AS current_stage, coalesce(samples, 0) AS samples
        FROM (VALUES (4096), (8192), (16384), (32768), (65536)) e(length) LEFT JOIN d ON d.length = e.length""",
    "a23_stage_middles": f"WITH {STEPS} SELECT CASE WHEN step <= 7 THEN 1 WHEN step <= 20 THEN 2 ELSE 3 END AS stage, (min(step) + max(step)) / 2 AS mid_x, count(*) AS steps FROM (SELECT DISTINCT step FROM steps WHERE step <= 25) GROUP BY 1",
    "p23_classify": "WITH p AS (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN 'Passage 2: ' WHEN 1 THEN 'passage 2: UUID ' ELSE '' END || text) AS x FROM documents) SELECT doc_id, CASE WHEN NOT contains(x, 'passage 2:') THEN 'other' WHEN contains(x, 'uuid') THEN 'long_qa_chain' ELSE 'long_qa' END AS cls FROM p",
    "p25_stage_labels": f"WITH {STEPS} SELECT DISTINCT step, CASE WHEN step * 10 <= 43 THEN 1 WHEN step * 10 <= 212 THEN 2 ELSE 3 END AS small, CASE WHEN step * 10 <= 169 THEN 1 ELSE 2 END AS large FROM steps",
    "s2_k2_json_lines": "SELECT conv_id, turn, text, role FROM conversations",
    "s3_json_lines_lenient": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10 <> 3",
    "s6_k4_csv": "SELECT doc_id, quality, toxic FROM labels",
    "s7_k3_parquet": "SELECT doc_id, quality, toxic FROM labels",
    "s12_missing_chunks": "SELECT 'chunk_' || i AS file_name FROM unnest(range(7)) AS t(i) WHERE i NOT IN (SELECT CAST(floor(doc_id / ceil((SELECT count(*) FROM documents) / 5)) AS BIGINT) FROM documents)",
    "p3_p5_hard_answerable": "SELECT (doc_id % 3 + 2) || 'hop__' || doc_id AS id, lang AS answer, source || chr(10) || lang AS passage, 0 AS support FROM documents WHERE n_chars > 500 AND doc_id % 3 + 2 IN (3, 4)",
    "p6_as_list": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN lang ELSE '' END AS items FROM documents",
    "p7_p20_first_value": "SELECT doc_id, coalesce(nullif(quality, 0), toxic) AS filled, coalesce(nullif(toxic, 0), quality + 5) AS truthy FROM labels",
    "j11_lengths": "SELECT labels.*, n_chars AS length FROM labels JOIN documents USING (doc_id)",
    "o8_first_distinct": "WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) AS k FROM f) SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS roles FROM r WHERE k <= 2 GROUP BY conv_id",
    "o9_supporting_only": f"""WITH {OWN}, s AS (SELECT qid, k, text, {draw('qid', 'k')} AS d FROM own JOIN (VALUES (0, 0), (1, 2), (2, 2)) v(k, p) ON p = pos),
        n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d) AS i FROM s) SELECT qid AS id, md5(string_agg('Passage ' || i || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS digest FROM n GROUP BY qid""",
    "o17_o18_last_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 25",
    "u1_union_counted": "SELECT * FROM labels",
    "u4_not_listed": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "m1_latest_stage": "SELECT event_type AS dataset, CAST(user_id % 4 AS INT) AS length, 'filtered' AS stage, event_id AS samples FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts DESC, event_id DESC) = 1",
    "s1_s4_json_arrays": "SELECT doc_id, quality, toxic FROM labels",
    "s8_files_by_pattern": "SELECT doc_id, source, true AS named FROM documents",
    "s9_step_logs": f"WITH {STEPS} SELECT step, cls AS input, count(*) AS n, sum(score) AS total FROM steps GROUP BY ALL",
    "s9_missing_steps": f"WITH {STEPS} SELECT step FROM (SELECT unnest(range(1, 41)) AS step) WHERE step NOT IN (SELECT step FROM steps)",
    "s11_metric_history": f"""{METRICS} SELECT run, step, 'right' AS key, "right" AS value FROM metrics""",
    "s13_p1_question_set": "SELECT CAST(doc_id AS VARCHAR) AS id, source AS query, lang AS answer, md5(lang || chr(10) || text) AS digest, '0,0' AS support, 'hard' AS level FROM documents",
    "s14_literal_table": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0.25::DOUBLE), (2, 0.5), (5, 0.125)) v(step, score)",
    "k1_ascii_lines": "SELECT doc_id, lang, md5(text) AS digest, true AS ascii FROM documents",
    "k6_output_names": "SELECT event_id, 'train-num_sample_' || user_id || '-max_seq_' || event_id || '-tag-cleaned' AS name FROM events",
    "k7_reused_output": "SELECT doc_id, quality, toxic FROM labels",
    "p4_possible_questions": "SELECT lang AS query, source AS answer, md5('A: ' || text) AS digest, 'B: ' || doc_id AS more FROM documents WHERE doc_id % 3 <> 0",
    "f13_unwrapped_text": "SELECT doc_id, md5(CASE doc_id % 4 WHEN 1 THEN text || '} and' ELSE text END) AS digest FROM documents",
    "f21_sequence_length": f"SELECT doc_id, {TOKENS.format(x='text')} + 128 AS length FROM documents",
    "v2_schema_check": "SELECT * FROM (VALUES ('length'), ('model')) v(name)",
    "i6_failed_calls": """SELECT item_id AS id, CAST(pos AS INT) AS pos, pos || ': ' || text AS text, CAST(NULL AS VARCHAR) AS error FROM benchmark, unnest(range(2)) AS r(pos) WHERE length(text) % 2 = 0
        UNION ALL SELECT item_id, CAST(-1 AS INT), '', 'ValueError: ' || length(text) || ' characters' FROM benchmark WHERE length(text) % 2 = 1""",
    "i2_difficulty": "SELECT item_id AS id FROM benchmark WHERE length(text) % 9 BETWEEN 1 AND 6 OR (length(text) % 9 = 0 AND length(text) % 5 > 0)",
    "i3_trajectories": """SELECT item_id AS "index", CAST(k AS BIGINT) AS num_correct, k / 4 AS pass_rate, array_to_string(list_transform(range(4), lambda i: CASE WHEN i < k THEN 'w' || item_id ELSE 'zzz' END), ',') AS answers, 'model' AS model
        FROM (SELECT item_id, length(text) % 5 AS k FROM benchmark)""",
    "i7_not_solved_again": "SELECT item_id AS id, (length(text) % 5) / 4 AS avg_acc FROM benchmark WHERE length(text) % 5 < 4",
    "i4_i5_retried_calls": "SELECT item_id AS id, CAST(pos AS INT) AS pos, text || ' ' || pos AS text FROM benchmark, unnest(range(3)) AS r(pos)",
}
SQL["k5_summary_file"] = SQL["a5_file_summary"]
SQL["o3_back_off"] = SQL["o2_budget_fit"].replace("<= 16384", "<= 4096")
