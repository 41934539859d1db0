"""The word table of quillmeter.sources.words as SQL, rebuilt from documents."""

from quillmeter.sources import words as S

LINES = f"""(SELECT doc_id, line_no, line,
  CAST(COALESCE(sum(greatest(1, ceil(length(line) / {S.WIDTH}.0))) OVER w, 0) AS BIGINT) AS first_row,
  CAST(COALESCE(sum(length(line) + 1) OVER w, 0) AS BIGINT) AS first_char
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

WORDS = f"""(SELECT doc_id, CAST(r // {S.LINES} + 1 AS BIGINT) AS page, first_char + off AS word_id, word AS text,
  (off % {S.WIDTH}) * {S.CHAR_W}::DOUBLE AS x0, (r % {S.LINES}) * {S.LINE_H}::DOUBLE AS y0,
  (off % {S.WIDTH}) * {S.CHAR_W}::DOUBLE + length(word) * {S.CHAR_W}::DOUBLE AS x1,
  (r % {S.LINES}) * {S.LINE_H}::DOUBLE + CASE WHEN line_no = 0 THEN {S.HEADING_FONT} ELSE {S.FONT} END::DOUBLE AS y1,
  CASE WHEN line_no = 0 THEN {S.HEADING_FONT} ELSE {S.FONT} END::DOUBLE AS font_size, line_no = 0 AS bold,
  (50 + (first_char + off) % 50) / 100.0::DOUBLE AS confidence
  FROM (SELECT *, first_row + off // {S.WIDTH} AS r FROM (
    SELECT *, CAST(COALESCE(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
    FROM (SELECT doc_id, line_no, first_row, first_char, unnest(w) AS word, generate_subscripts(w, 1) AS pos
      FROM (SELECT *, string_split(line, ' ') AS w FROM {LINES})))) WHERE length(word) > 0)"""
