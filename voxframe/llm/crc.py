"""CRC-32 of the decimal text of whole numbers in plain SQL, for the comparison queries."""

from __future__ import annotations

POLYNOMIAL = 0xEDB88320


def crc32_ctes(ids: str) -> str:
    """Common table expressions that end in ``crcs`` (id, crc), for the distinct ``id`` of the query ``ids``; needs WITH RECURSIVE."""
    return f"""
crc_steps AS (
  SELECT b AS byte, 0 AS k, CAST(b AS BIGINT) AS v FROM range(256) r(b)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, {POLYNOMIAL}) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT byte, v FROM crc_steps WHERE k = 8),
crc_run AS (
  SELECT id, CAST(id AS VARCHAR) AS digits, 1 AS place, CAST(4294967295 AS BIGINT) AS v FROM ({ids}) WHERE id IS NOT NULL
  UNION ALL
  SELECT r.id, r.digits, r.place + 1, xor(r.v >> 8, t.v) FROM crc_run r JOIN crc_table t ON t.byte = xor(r.v, ascii(substr(r.digits, r.place, 1))) & 255
  WHERE r.place <= length(r.digits)),
crcs AS (SELECT id, xor(v, 4294967295) AS crc FROM crc_run WHERE place = length(digits) + 1)"""
