"""SQL counterparts of the registered queries, for an independent engine.

Written from the meaning of each query in plain relational terms: where the jobs
avoid joins or windows for the sake of scale, the SQL uses them.
"""

from __future__ import annotations

from paperloom import fixed_values as fixed
from paperloom.functions import prompt_texts
from paperloom.plans import catalog

SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _uuid(seed: str) -> str:
    parts = ", ".join(
        f"substr(md5({seed}), {start}, {size})"
        for start, size in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    )
    return f"concat_ws('-', {parts})"


_WORDS = r"[\p{L}\p{N}]+"

UPLOADS = f"""
uploads AS (
  SELECT *, 'landing/' || source || '/' || doc_id || '/' || file_name AS path
  FROM (
    SELECT *, CASE doc_id % 3
        WHEN 0 THEN upper({_uuid("doc_id::VARCHAR")}) || '.PDF'
        WHEN 1 THEN 'scan_' || {_uuid("doc_id::VARCHAR")} || '.pdf'
        ELSE 'note.' || lang || '.txt' END AS file_name
    FROM documents)
)"""

WORD_COUNT = f"len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> ''))"

CHUNKS = """
chunks AS (
  SELECT doc_id AS document_id, i AS chunk_index, substr(text, i * 800 + 1, 1000) AS chunk_text
  FROM (
    SELECT doc_id, text,
      unnest(generate_series(0, greatest(ceil((length(text) - 200) / 800.0)::BIGINT, 1) - 1)) AS i
    FROM documents)
  WHERE substr(text, i * 800 + 1, 1000) <> ''
)"""

CHUNK_BUCKETS = f"""
chunk_buckets AS (
  SELECT document_id, chunk_index, ('0x' || substr(md5(word), 1, 8))::BIGINT % 256 AS bucket,
    count(*) AS n
  FROM (
    SELECT document_id, chunk_index, unnest(regexp_extract_all(lower(chunk_text), '{_WORDS}')) AS word
    FROM chunks)
  GROUP BY ALL
)"""

def _ranked(questions: str) -> str:
    """The three best chunks of each row of ``questions`` (query_id, query)."""
    return f"""{CHUNKS},
{CHUNK_BUCKETS},
chunk_squares AS (
  SELECT document_id, chunk_index, sum(n * n) AS squares FROM chunk_buckets GROUP BY ALL
),
question_buckets AS (
  SELECT query_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n
  FROM (
    SELECT query_id, unnest(regexp_extract_all(lower(query), '{_WORDS}')) AS word
    FROM {questions})
  GROUP BY ALL
),
question_squares AS (
  SELECT query_id, sum(n * n) AS squares FROM question_buckets GROUP BY ALL
),
dots AS (
  SELECT query_id, document_id, chunk_index, sum(q.n * c.n) AS dot
  FROM question_buckets q JOIN chunk_buckets c USING (bucket)
  GROUP BY ALL
),
scored AS (
  SELECT query_id, document_id, chunk_index,
    coalesce(dot, 0)::DOUBLE / sqrt((q.squares * c.squares)::DOUBLE) AS score
  FROM question_squares q CROSS JOIN chunk_squares c
    LEFT JOIN dots USING (query_id, document_id, chunk_index)
),
ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY query_id ORDER BY round(score, 12) DESC, document_id, chunk_index) AS rank
    FROM scored)
  WHERE rank <= 3
)"""


RANKED = _ranked("(SELECT item_id AS query_id, text AS query FROM benchmark)")

CONTEXT = f"""{RANKED},
context AS (
  SELECT item_id AS query_id, b.text AS query, coalesce(found.context, '') AS context
  FROM benchmark b LEFT JOIN (
    SELECT query_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM ranked JOIN chunks USING (document_id, chunk_index)
    GROUP BY query_id) found ON found.query_id = b.item_id
)"""


def _template_sql(template: str, slots: dict[str, str]) -> str:
    """The template as a concatenation, its slots replaced by SQL expressions."""
    pieces = [("text", template)]
    for name, expression in slots.items():
        mark = "{" + name + "}"
        cut: list[tuple[str, str]] = []
        for kind, piece in pieces:
            if kind == "sql" or mark not in piece:
                cut.append((kind, piece))
                continue
            for i, part in enumerate(piece.split(mark)):
                if i:
                    cut.append(("sql", expression))
                if part:
                    cut.append(("text", part))
        pieces = cut
    return " || ".join(_quoted(piece) if kind == "text" else piece for kind, piece in pieces)


PROMPT = _template_sql(prompt_texts.RAG_PROMPT, {"context": "context", "question": "query"})

DOCUMENT_CONTEXT = """
contexts AS (
  SELECT doc_id // 4 AS conv_id, count(*) AS documents,
    string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS plain,
    string_agg(text, chr(10) ORDER BY doc_id) AS lines,
    string_agg('Document ' || place || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)
      AS numbered
  FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS place
    FROM documents)
  GROUP BY 1
)"""


ALL_TURNS = "admitted AS (SELECT conv_id, turn, role, text FROM conversations)"


def _admitted(cap: int) -> str:
    return f"""
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS asked
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
admitted AS (
  SELECT conv_id, turn, role, text FROM placed
  WHERE place < {cap} OR (place = {cap} AND role = 'assistant' AND asked = 'user')
)"""


REQUESTS = """
requests AS (
  SELECT conv_id * 1000 + turn AS query_id,
    CASE conv_id % 5
      WHEN 0 THEN 'Summarize this: ' WHEN 1 THEN 'Translate to French: '
      WHEN 2 THEN 'Find documents about '
      WHEN 3 THEN 'Find texts, summarise and translate them: ' ELSE '' END || text AS query,
    CASE conv_id % 5 WHEN 1 THEN 'French' WHEN 3 THEN 'German' END AS target_language,
    turn % 3 = 1 AS has_documents
  FROM conversations WHERE role = 'user'
)"""


def _templates_in_force() -> dict[str, str]:
    newest: dict[str, tuple[int, str]] = {}
    for name, version, template in catalog.REGISTRY:
        if name in fixed.PROMPT_NAMES and version >= newest.get(name, (0, ""))[0]:
            newest[name] = (version, template)
    registered = {name: template for name, (_, template) in newest.items()}
    return {**prompt_texts.DEFAULT_TEMPLATES, **registered}


def _task_prompt_sql() -> str:
    templates = _templates_in_force()
    slots = {
        "text": "query",
        "target_language": f"coalesce(target_language, {_quoted(prompt_texts.UNNAMED_LANGUAGE)})",
    }
    cases = []
    for number, task in enumerate(("translate_text", "summarize_text", "retrieve_document")):
        cases.append(f"WHEN {number} THEN {_template_sql(templates[task], slots)}")
    return f"""
WITH {REQUESTS}
SELECT query_id,
  CASE query_id % 4 WHEN 0 THEN 'translate_text' WHEN 1 THEN 'summarize_text'
    WHEN 2 THEN 'retrieve_document' ELSE 'unknown_prompt' END AS task,
  CASE query_id % 4 {' '.join(cases)} END AS prompt
FROM requests"""


def _written_sql(turns: str) -> str:
    """``written``: per user turn of ``turns`` (CTE ``admitted``), what was said before."""
    preamble = f"{_quoted(fixed.DOCUMENTS_PREAMBLE)} || numbered || chr(10)"
    acknowledged = _quoted(fixed.DOCUMENTS_ACKNOWLEDGED)
    return f"""
{turns}, {DOCUMENT_CONTEXT},
shown AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM admitted WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
pairs AS (
  SELECT conv_id, turn AS asked_at, text AS question, next_text AS answer
  FROM shown WHERE role = 'user' AND next_role = 'assistant'
),
history AS (
  SELECT s.conv_id, s.turn, s.text,
    coalesce(list('human' || chr(0) || question ORDER BY asked_at)
      FILTER (question IS NOT NULL), []) AS questions,
    coalesce(list('ai' || chr(0) || answer ORDER BY asked_at)
      FILTER (question IS NOT NULL), []) AS answers
  FROM shown s LEFT JOIN pairs p ON p.conv_id = s.conv_id AND p.asked_at < s.turn
  WHERE s.role = 'user'
  GROUP BY ALL
),
called AS (
  SELECT h.conv_id, h.turn, h.text, numbered,
    list_concat(
      CASE WHEN numbered IS NULL THEN [] ELSE
        ['human' || chr(0) || {preamble}, 'ai' || chr(0) || {acknowledged}] END,
      flatten(list_transform(list_zip(questions, answers), lambda p: [p[1], p[2]]))) AS earlier
  FROM history h LEFT JOIN contexts USING (conv_id)
),
written AS (
  SELECT *, array_to_string(
    list_transform(earlier, lambda m: replace(m, chr(0), ': ')), chr(10)) AS transcript
  FROM called
)"""


def _agent_messages_sql() -> str:
    system = _template_sql(
        prompt_texts.DEFAULT_TEMPLATES["orchestrator_agent_prompt"],
        {"chat_history": "transcript", "input": "text"},
    )
    return f"""
WITH {_written_sql(ALL_TURNS)}
SELECT conv_id, turn, len(earlier) + 2 AS messages,
  md5(array_to_string(list_concat(
    ['system> ' || {system}],
    list_transform(earlier, lambda m: replace(m, chr(0), '> ')),
    ['human> ' || text]), chr(10))) AS digest
FROM written"""


def _answer_turns_sql() -> str:
    templates = _templates_in_force()
    system = _template_sql(
        templates["orchestrator_agent_prompt"], {"chat_history": "transcript", "input": "text"}
    )
    spoken = """CASE WHEN role = 'user' THEN CASE conv_id % 4 WHEN 0 THEN 'Summarize this: '
      WHEN 1 THEN 'Translate it to French: ' WHEN 2 THEN 'Summarise and translate it into German: '
      ELSE '' END || text ELSE text END"""
    turns = f"""
turns AS (SELECT conv_id, turn, role, {spoken} AS text FROM conversations),
{_admitted(fixed.MESSAGE_CAP).replace("FROM conversations", "FROM turns")}"""
    language = "CASE conv_id % 4 WHEN 1 THEN 'French' ELSE 'German' END"
    summarize = _cleaned(f"({_agent_call('summarize_text', 'text', language)})")
    translate = _cleaned(f"({_agent_call('translate_text', 'text', language)})")
    whole = f"""array_to_string(list_concat(['system: ' || {system}],
      list_transform(earlier, lambda m: replace(m, chr(0), ': ')), ['human: ' || text]), chr(10))"""
    return f"""
WITH {_written_sql(turns)},
given AS (
  SELECT *, coalesce(numbered || chr(10) || chr(10) || text, text) AS given FROM written
),
summarized AS (
  SELECT * EXCLUDE (given), CASE WHEN conv_id % 4 IN (0, 2) THEN {summarize} ELSE given END AS given
  FROM given
),
translated AS (
  SELECT * EXCLUDE (given), CASE WHEN conv_id % 4 IN (1, 2) THEN {translate} ELSE given END AS given
  FROM summarized
)
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'summarize' WHEN 1 THEN 'translate'
    WHEN 2 THEN 'summarize,translate' ELSE 'answer' END AS steps,
  md5(CASE WHEN conv_id % 4 = 3 THEN {_cleaned(whole)} ELSE given END) AS digest, 'ok' AS status
FROM translated"""


def _found_steps() -> str:
    """Steps per request: ``filled`` (query_id, steps)."""
    patterns = catalog.tasks.STEP_PATTERNS
    steps = ", ".join(
        f"CASE WHEN regexp_matches(lower(query), {_quoted(pattern)})"
        f"{' AND NOT has_documents' if step == 'retrieve' else ''} THEN '{step}' END"
        for step, pattern in patterns.items()
    )
    return f"""{REQUESTS},
found AS (
  SELECT query_id, list_filter([{steps}], lambda s: s IS NOT NULL) AS steps FROM requests
),
filled AS (
  SELECT query_id, CASE WHEN len(steps) = 0 THEN ['answer'] ELSE steps END AS steps FROM found
)"""


def _steps_sql() -> str:
    return f"""
WITH {_found_steps()}
SELECT query_id, unnest(generate_series(1, len(steps))) AS step_no, unnest(steps) AS step
FROM filled"""


def _agent_call(task: str, request: str, language: str) -> str:
    """What a task's model is given: its agent's system prompt, then the prompt."""
    templates = _templates_in_force()
    agent = templates[catalog.tasks.AGENTS[task]]
    system = _template_sql(agent, {"chat_history": "''", "input": request})
    given = request if task == "retrieve_document" else "given"
    prompt = _template_sql(templates[task], {"text": given, "target_language": language})
    if task == "retrieve_document":
        slots = {"context": "given", "question": f"({prompt})"}
        prompt = _template_sql(prompt_texts.RAG_PROMPT, slots)
    return f"'system: ' || {system} || chr(10) || 'human: ' || {prompt}"


def _agents_sql(fails: str) -> str:
    """``done``: text and error of each request after its steps. ``fails``: when a model
    refuses its ``prompt``; it gives back others."""
    language = f"coalesce(target_language, {_quoted(prompt_texts.UNNAMED_LANGUAGE)})"
    parts = []
    tasks = [
        ("retrieve", "retrieve_document", _agent_call("retrieve_document", "query", language)),
        ("summarize", "summarize_text", _agent_call("summarize_text", "query", language)),
        ("translate", "translate_text", _agent_call("translate_text", "query", language)),
        ("answer", "call_agent", "query"),
    ]
    before = "retrieved"
    for step, task, prompt in tasks:
        message = "'prompt of ' || length(prompt) || ' characters refused'"
        parts.append(f"""
{step}_prompt AS (
  SELECT *, CASE WHEN error IS NULL AND list_contains(steps, '{step}') THEN {prompt} END AS prompt
  FROM {before}
),
{step}_done AS (
  SELECT query_id, query, target_language, steps,
    CASE WHEN prompt IS NULL THEN given WHEN {fails}
      THEN {_quoted(fixed.ERROR_PREFIXES[task])} || {message} ELSE {_cleaned("prompt")} END AS given,
    CASE WHEN prompt IS NOT NULL AND {fails} THEN {message} ELSE error END AS error
  FROM {step}_prompt
)""")
        before = f"{step}_done"
    return f"""{_found_steps()},
searching AS (
  SELECT query_id, query FROM requests JOIN filled USING (query_id)
  WHERE list_contains(steps, 'retrieve')
),
{_ranked("searching")},
excerpts AS (
  SELECT query_id, string_agg('[' || document_id || '#' || chunk_index || '] ' || chunk_text,
    chr(10) || chr(10) ORDER BY rank) AS excerpts
  FROM ranked JOIN chunks USING (document_id, chunk_index) GROUP BY query_id
),
retrieved AS (
  SELECT requests.query_id, query, target_language, steps, NULL::VARCHAR AS error,
    CASE WHEN list_contains(steps, 'retrieve')
      THEN coalesce(excerpts, {_quoted(prompt_texts.NO_EXCERPTS)}) ELSE query END AS given
  FROM requests JOIN filled USING (query_id) LEFT JOIN excerpts USING (query_id)
),{",".join(parts)},
done AS (SELECT * FROM {before})"""


def _agent_answers_sql() -> str:
    return f"""
WITH {_agents_sql("false")}
SELECT query_id, array_to_string(steps, ',') AS steps, given AS response, 'ok' AS status FROM done"""


def _agent_errors_sql() -> str:
    return f"""
WITH {_agents_sql("length(prompt) % 3 = 0")}
SELECT query_id, array_to_string(steps, ',') AS steps, given AS response, error
FROM done WHERE error IS NOT NULL"""


SENTENCE = "[^.!?]+[.!?]*"

ANSWER = f"""
WITH {CONTEXT},
sentences AS (
  SELECT query_id, query, place, {_strip("sentence")} AS sentence FROM (
    SELECT query_id, query,
      unnest(regexp_extract_all(context, '{SENTENCE}')) AS sentence,
      generate_subscripts(regexp_extract_all(context, '{SENTENCE}'), 1) AS place
    FROM context)
),
shared AS (
  SELECT query_id, place, sentence,
    len(list_intersect(list_distinct(regexp_extract_all(lower(query), '{_WORDS}')),
      list_distinct(regexp_extract_all(lower(sentence), '{_WORDS}')))) AS common
  FROM sentences WHERE sentence <> ''
),
best AS (
  SELECT query_id, sentence FROM shared
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY common DESC, place) = 1
)
SELECT query_id, coalesce(sentence, '{fixed.NO_OUTPUT}') AS response, 'ok' AS status
FROM context LEFT JOIN best USING (query_id)"""

SUMMARY = f"""
WITH cut AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{SENTENCE}')) AS sentence,
    generate_subscripts(regexp_extract_all(text, '{SENTENCE}'), 1) AS place
  FROM documents
),
sentences AS (
  SELECT doc_id, place, {_strip("sentence")} AS sentence,
    regexp_extract_all(lower(sentence), '{_WORDS}') AS words
  FROM cut WHERE len(regexp_extract_all(lower(sentence), '{_WORDS}')) > 0
),
words AS (SELECT doc_id, place, unnest(words) AS word FROM sentences),
frequency AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL),
weights AS (
  SELECT doc_id, place, sum(n)::DOUBLE / count(*) AS weight
  FROM words JOIN frequency USING (doc_id, word) GROUP BY ALL
),
ordered AS (
  SELECT doc_id, place, sentence,
    row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, place) AS rank,
    count(*) OVER (PARTITION BY doc_id) AS size
  FROM sentences JOIN weights USING (doc_id, place)
),
summaries AS (
  SELECT doc_id, string_agg(sentence, ' ' ORDER BY place) AS summary
  FROM ordered
  WHERE rank <= CASE WHEN size > {catalog.tasks.COMPLEX_SENTENCES}
    THEN {catalog.tasks.COMPLEX_SUMMARY_SENTENCES} ELSE {catalog.tasks.SUMMARY_SENTENCES} END
  GROUP BY doc_id
)
SELECT doc_id, coalesce(summary, '') AS summary
FROM documents LEFT JOIN summaries USING (doc_id)"""

OUTPUT = """
CASE WHEN role = 'system' THEN NULL
  WHEN turn % 4 = 0 THEN '<think>' || text || '</think>' || chr(10) || ' ' || text || chr(9) || chr(10)
  WHEN turn % 4 = 1 THEN 'Thought: ' || text || chr(10) || 'Observation: ' || text
  WHEN turn % 4 = 2 THEN text || ' Action: find' || chr(10) || 'Action Input: ' || text || chr(10)
    || 'Observation:' || '<think>a</think>' || text
  ELSE '<think>open ' || text END"""


def _cleaned(output: str) -> str:
    cleaned = f"coalesce({output}, '{fixed.NO_OUTPUT}')"
    for pattern in fixed.CLEANING_PATTERNS:
        cleaned = f"regexp_replace({cleaned}, '{pattern}', '', 'g')"
    return _strip(cleaned)


ARCHIVE = """
WITH files AS (
  SELECT 'landing/' || doc_id || '/' || file_name AS src_path, file_name FROM (
    SELECT *, CASE doc_id % 4 WHEN 0 THEN lang || '.pdf' WHEN 1 THEN lang || '_1.pdf'
      WHEN 2 THEN source || '.v2.pdf' ELSE source END AS file_name
    FROM documents)
),
taken AS (
  SELECT lang || '_' || doc_id || '.pdf' AS file_name
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
),
names AS (
  SELECT DISTINCT file_name, regexp_extract(file_name, '(\\.[^.]*)$', 1) AS extension,
    regexp_extract(file_name, '^(.*?)(\\.[^.]*)?$', 1) AS stem
  FROM files
),
used AS (
  SELECT DISTINCT names.file_name, counter
  FROM names, (SELECT file_name AS other FROM taken UNION SELECT file_name FROM files) occupied,
    LATERAL (SELECT CASE
      WHEN starts_with(other, stem || '_') AND ends_with(other, extension) THEN
        try_cast(nullif(regexp_extract(
          substr(other, length(stem) + 2, length(other) - length(stem) - 1 - length(extension)),
          '^[1-9][0-9]*$'), '') AS BIGINT)
      END AS counter) parsed
  WHERE counter IS NOT NULL
  UNION SELECT file_name, 0 FROM taken WHERE file_name IN (SELECT file_name FROM files)
),
gaps AS (
  SELECT file_name, counter - row_number() OVER (PARTITION BY file_name ORDER BY counter) + 1 AS free
  FROM used
),
asked AS (
  SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY md5(src_path)) - 1 AS place FROM files
),
counted AS (
  SELECT src_path, asked.file_name, place + count(free) AS counter
  FROM asked LEFT JOIN gaps ON gaps.file_name = asked.file_name AND free <= place
  GROUP BY src_path, asked.file_name, place
)
SELECT src_path, file_name,
  CASE WHEN counter = 0 THEN file_name ELSE stem || '_' || counter || extension END AS archive_name
FROM counted JOIN names USING (file_name)"""

DECODED = f"""{UPLOADS},
decoded AS (
  SELECT *, doc_id % 10 = 0 AS broken, replace(text, chr(10), '') AS whole FROM uploads
)"""

ORACLES: dict[str, str] = {
    "landing_filter": f"""
WITH {UPLOADS}
SELECT doc_id, file_name FROM uploads WHERE lower(file_name) LIKE '%.pdf'""",
    "landing_names": f"""
WITH {UPLOADS}
SELECT doc_id, {_uuid("doc_id::VARCHAR")} AS upload_id,
  '{catalog.LANDING}/' || {_uuid("doc_id::VARCHAR")} || '.' || split_part(file_name, '.', -1)
    AS landing_path
FROM uploads""",
    "document_uuid": f"""
WITH {UPLOADS}
SELECT doc_id, coalesce(
  nullif(regexp_extract(file_name, '{fixed.UUID_PATTERN}', 0), ''),
  {_uuid("path || '|' || n_chars")}) AS document_uuid
FROM uploads""",
    "document_meta": f"""
WITH {UPLOADS}
SELECT doc_id, split_part(path, '/', -1) AS file_name, {WORD_COUNT} AS word_count,
  '2024-05-01 12:00:00' AS upload_timestamp, '2024-05-01 12:00:00' AS created_at,
  '2024-05-02 12:00:00' AS expires_at
FROM uploads""",
    "ingest_documents": f"""
WITH {DECODED}
SELECT path AS file_path, file_name,
  length(text) - length(whole) + 1 AS page_count,
  {WORD_COUNT.replace("(text,", "(whole,")} AS word_count,
  '2024-05-01 12:00:00' AS created_at, '2024-05-02 12:00:00' AS expires_at,
  md5(whole) AS text_digest
FROM decoded WHERE NOT broken""",
    "ingest_errors": f"""
WITH {DECODED}
SELECT path AS file_path, file_name,
  '{fixed.EXTRACTION_FAILED}''utf-8'' codec can''t decode byte 0xff in position '
    || strlen(text) || ': invalid start byte' AS error_message,
  '2024-05-01 12:00:00' AS error_timestamp
FROM decoded WHERE broken""",
    "document_assemble": """
SELECT doc_id, len(string_split(text, chr(10))) AS page_count, replace(text, chr(10), '') AS text
FROM documents""",
    "archive_names": ARCHIVE,
    "latest_document": """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderkey
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "latest_one": f"""
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM orders WHERE o_custkey = {catalog.LOOKUP_KEY}
ORDER BY orders.o_orderdate DESC, o_orderkey DESC LIMIT 1""",
    "duplicate_keys": """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
  count(*) AS occurrences
FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1""",
    "chunk_document_join": f"""
WITH {CHUNKS},
newest AS (
  SELECT text, doc_id AS document_id FROM documents
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id * 7919 % 1000 DESC, doc_id DESC) = 1
)
SELECT doc_id, {_uuid("text")} AS document_uuid, chunk_index,
  length(chunk_text) AS chunk_size, newest.document_id
FROM chunks JOIN documents ON doc_id = chunks.document_id JOIN newest USING (text)""",
    "chunk_rejects": f"""
WITH {CHUNKS},
keyed AS (SELECT doc_id, {_uuid("text")} AS document_uuid FROM documents)
SELECT doc_id, document_uuid, chunk_index::BIGINT AS chunk_index,
  length(chunk_text) AS chunk_size
FROM chunks JOIN keyed ON doc_id = document_id
WHERE document_uuid NOT IN (SELECT document_uuid FROM keyed WHERE doc_id % 3 > 0)""",
    "orphan_chunks": f"""
WITH {CHUNKS}
SELECT document_id, chunk_index, length(chunk_text) AS chunk_size FROM chunks
WHERE document_id NOT IN (SELECT doc_id FROM labels)""",
    "unchunked_documents": """
SELECT doc_id, lang, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR text = ''""",
    "pending_chunks": f"""
WITH {CHUNKS}
SELECT document_id, chunk_index, length(chunk_text) AS chunk_size FROM chunks
WHERE NOT EXISTS (
  SELECT 1 FROM embeddings WHERE vec_id = document_id AND label % 3 = chunk_index)""",
    "chunk_fixed": f"""
WITH {CHUNKS}
SELECT document_id, chunk_index, chunk_text, length(chunk_text) AS chunk_size FROM chunks""",
    "chunk_rebuild": f"""
SELECT doc_id AS document_id, md5(bare) AS digest, length(bare) AS characters
FROM (SELECT doc_id, regexp_replace(text, '{SPACE}+', '', 'g') AS bare FROM documents)
WHERE bare <> ''""",
    "chunk_report": f"""
WITH {CHUNKS}
SELECT document_id, count(*) AS chunks, sum(length(chunk_text))::BIGINT AS characters,
  max(chunk_index) AS last_index
FROM chunks GROUP BY document_id""",
    "hashed_embedding": f"""
WITH {CHUNKS}, {CHUNK_BUCKETS}
SELECT document_id, chunk_index, bucket, n::DOUBLE AS value,
  round(n::DOUBLE / sqrt((sum(n * n) OVER (PARTITION BY document_id, chunk_index))::DOUBLE), 6)
    AS unit_value
FROM chunk_buckets""",
    "vector_topk": """
WITH vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
    list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS squares
  FROM embeddings
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS document_id, c.label AS chunk_index,
    list_dot_product(q.v, c.v) / sqrt(q.squares * c.squares) AS score
  FROM vectors q, vectors c
)
SELECT query_id, rank, document_id, chunk_index::BIGINT AS chunk_index, round(score, 4) AS score
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY round(score, 12) DESC, document_id, chunk_index) AS rank
  FROM scored)
WHERE rank <= 3""",
    "vector_topk_approximate": f"""
WITH vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
    list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS squares
  FROM embeddings
),
entries AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM vectors),
means AS (SELECT label, place, avg(x) AS x FROM entries GROUP BY ALL),
centres AS (SELECT label AS cell, list(x ORDER BY place) AS centre FROM means GROUP BY label),
placed AS (
  SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(
    list_dot_product(v, centre) / sqrt(squares * list_dot_product(centre, centre)), 12) DESC,
    cell) AS nearness
  FROM vectors, centres
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS document_id, c.label AS chunk_index,
    list_dot_product(q.v, c.v) / sqrt(q.squares * c.squares) AS score
  FROM vectors q
    JOIN placed p ON p.vec_id = q.vec_id AND p.nearness <= {catalog.CELL_PROBES}
    JOIN placed o ON o.cell = p.cell AND o.nearness = 1
    JOIN vectors c ON c.vec_id = o.vec_id
)
SELECT query_id, rank, document_id, chunk_index::BIGINT AS chunk_index, round(score, 4) AS score
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY round(score, 12) DESC, document_id, chunk_index) AS rank
  FROM scored)
WHERE rank <= 3""",
    "rag_topk": f"""
WITH {RANKED}
SELECT query_id, rank, document_id, chunk_index, round(score, 4) AS score FROM ranked""",
    "rag_context": f"WITH {CONTEXT} SELECT query_id, query, context FROM context",
    "rag_prompt": f"WITH {CONTEXT} SELECT query_id, query, context, {PROMPT} AS prompt FROM context",
    "rag_answer": ANSWER,
    "retrieve_excerpts": f"""
WITH {RANKED}
SELECT item_id AS query_id, b.text AS query,
  coalesce(found.excerpts, {_quoted(prompt_texts.NO_EXCERPTS)}) AS excerpts
FROM benchmark b LEFT JOIN (
  SELECT query_id, string_agg('[' || document_id || '#' || chunk_index || '] ' || chunk_text,
    chr(10) || chr(10) ORDER BY rank) AS excerpts
  FROM ranked JOIN chunks USING (document_id, chunk_index)
  GROUP BY query_id) found ON found.query_id = b.item_id""",
    "lexical_topk": f"""
WITH {CHUNKS},
held AS (
  SELECT document_id, chunk_index, word, count(*) AS n
  FROM (
    SELECT document_id, chunk_index, unnest(regexp_extract_all(lower(chunk_text), '{_WORDS}')) AS word
    FROM chunks)
  GROUP BY ALL
),
rarity AS (
  SELECT word, ln(1 + (SELECT count(*) FROM chunks) / count(*)) AS idf FROM held GROUP BY word
),
weights AS (
  SELECT document_id, chunk_index, word,
    n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY document_id, chunk_index)) AS weight
  FROM held JOIN rarity USING (word)
),
asked AS (
  SELECT item_id, word, count(*) AS n
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS word FROM benchmark)
  GROUP BY ALL
),
question_weights AS (
  SELECT item_id, word, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY item_id)) AS weight
  FROM asked JOIN rarity USING (word)
),
scored AS (
  SELECT item_id AS query_id, document_id, chunk_index, round(sum(q.weight * w.weight), 10) AS score
  FROM question_weights q JOIN weights w USING (word) GROUP BY ALL
)
SELECT query_id, rank, document_id, chunk_index, round(score, 6) AS score
FROM (
  SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS rank
  FROM scored)
WHERE rank <= 3""",
    "visible_turns": "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'",
    "conversation_cap": f"""
SELECT conv_id, count(*) AS messages, count(*) >= {catalog.SMALL_CAP} AS at_cap
FROM conversations GROUP BY conv_id""",
    "admitted_turns": f"""
WITH {_admitted(catalog.SMALL_CAP)} SELECT conv_id, turn, role, text FROM admitted""",
    "history_pairs": """
SELECT conv_id, turn, text AS question, next_text AS answer
FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""",
    "turn_history": f"""
WITH {ALL_TURNS}
SELECT u.conv_id, u.turn, count(b.turn) AS messages,
  coalesce(string_agg(b.role || ': ' || b.text, chr(10) ORDER BY b.turn), '') AS history
FROM admitted u LEFT JOIN admitted b ON b.conv_id = u.conv_id AND b.turn < u.turn
WHERE u.role = 'user'
GROUP BY u.conv_id, u.turn""",
    "closed_conversations": """
SELECT user_id AS conv_id, event_id AS turn, event_type FROM events e
WHERE NOT EXISTS (
  SELECT 1 FROM events earlier
  WHERE earlier.user_id = e.user_id AND earlier.event_id < e.event_id
    AND earlier.event_type = 'error')""",
    "chat_segments": """
SELECT event_id, user_id, sum((event_type = 'signup')::INT) OVER (
  PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS segment
FROM events""",
    "documents_context": f"""
WITH {DOCUMENT_CONTEXT} SELECT conv_id, documents, plain, numbered FROM contexts""",
    "seeded_turns": f"""
WITH {DOCUMENT_CONTEXT}
SELECT conv_id, turn, role, text FROM conversations
UNION ALL
SELECT conv_id, -1, 'system',
  {_quoted(prompt_texts.DOCUMENT_SEED[0])} || plain || {_quoted(prompt_texts.DOCUMENT_SEED[1])}
FROM contexts
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
    "feedback_text": f"""
WITH {ALL_TURNS}, {DOCUMENT_CONTEXT},
messages AS (
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS messages FROM admitted GROUP BY conv_id
)
SELECT conv_id,
  coalesce(lines, '') || chr(10) || chr(10) || coalesce(messages, '') AS text
FROM messages FULL JOIN contexts USING (conv_id)""",
    "feedback_rows": """
SELECT event_id, event_type AS text, props AS comments,
  CASE WHEN event_type = 'view' THEN 3 WHEN event_id % 7 IN (0, 1) THEN NULL
    ELSE floor(value / 70)::BIGINT END AS rating,
  coalesce(rating BETWEEN 1 AND 5, false) AS accepted, '2024-05-01 12:00:00' AS created_at
FROM events""",
    "clean_response": f"SELECT conv_id, turn, {_cleaned(OUTPUT)} AS response FROM conversations",
    "route_requests": _steps_sql(),
    "task_prompts": _task_prompt_sql(),
    "agent_messages": _agent_messages_sql(),
    "extractive_summary": SUMMARY,
    "agent_answers": _agent_answers_sql(),
    "agent_errors": _agent_errors_sql(),
    "answer_turns": _answer_turns_sql(),
}

# The search by bounds gives the rows of the search that compares everything.
ORACLES["vector_topk_bounds"] = ORACLES["vector_topk"]
# Histories from shared blocks are those from the turns.
ORACLES["turn_history_blocks"] = ORACLES["turn_history"]
