"""The pN_ queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import docpairs, mixing, neardup, neighbours, pairdefects, pii, scanrepair, splitter, tokenids
from lodestrata.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: neighbours.found(table(s, d, "chunk")),
    "p1_neighbours": lambda s, d: neighbours.most_similar(table(s, d, "chunk")),
    # ids are texts here: the queries are the rows whose hashed id is divisible by 100, searched in all rows
    "p1_search": lambda s, d: neighbours.search(table(s, d, "chunk"), "id", "embeddings", table(s, d, "chunk").filter("pmod(xxhash64(id), 100) = 0")),
    "p2_found": lambda s, d: docpairs.found(table(s, d, "chunk")),
    "p2_pairs": lambda s, d: docpairs.document_pairs(table(s, d, "chunk")),
    "p3_found": lambda s, d: neardup.found(table(s, d, "chunk")),
    "p3_groups": lambda s, d: neardup.groups(table(s, d, "chunk")),
    "p4_found": lambda s, d: pairdefects.found(table(s, d, "chats"), table(s, d, "lexicon")),
    "p4_tags": lambda s, d: pairdefects.tag_pairs(table(s, d, "chats"), table(s, d, "lexicon")),
    "p5_found": lambda s, d: scanrepair.found(table(s, d, "chunk"), table(s, d, "lexicon")),
    "p5_repaired": lambda s, d: scanrepair.repaired(table(s, d, "chunk"), table(s, d, "lexicon")),
    "p6_found": lambda s, d: splitter.found(table(s, d, "chunk"), table(s, d, "size_limits")),
    "p6_cover": lambda s, d: splitter.covered(table(s, d, "chunk"), table(s, d, "size_limits")),
    "p6_pieces": lambda s, d: splitter.split_oversized(table(s, d, "chunk"), table(s, d, "size_limits")),
    "p7_ids": lambda s, d: tokenids.encode_corpus(table(s, d, "documents")),
    "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_report": lambda s, d: mixing.mix_report(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: pii.found(table(s, d, "documents"), table(s, d, "given_names"), table(s, d, "lexicon")),
    "p9_redacted": lambda s, d: pii.redact_texts(table(s, d, "documents"), table(s, d, "given_names"), table(s, d, "lexicon")),
}

# Problem 6 can be told from the text alone: a cut is forced where a long enough stretch has no boundary.
ORACLE_SQL: dict[str, str] = {
    "p6_found": r"""
        WITH l AS (SELECT lower(trim(chunk_type)) AS kind, max_chars FROM size_limits),
        c AS (SELECT DISTINCT id, document, lower(trim(chunk_type)) AS kind FROM chunk WHERE document IS NOT NULL),
        j AS (SELECT c.id, c.document, coalesce(l.max_chars, (SELECT max_chars FROM l WHERE kind = '*')) AS m
              FROM c LEFT JOIN l ON l.kind = c.kind AND l.kind <> '*')
        SELECT id, CASE WHEN list_max(list_transform(string_split_regex(document, '[\s.!?;。！？]'), lambda x: length(x))) > m
                        THEN 'forced' ELSE 'natural' END AS cut
        FROM j WHERE length(document) > m""",
    "p6_cover": """
        WITH l AS (SELECT lower(trim(chunk_type)) AS kind, max_chars FROM size_limits),
        c AS (SELECT DISTINCT id, document, lower(trim(chunk_type)) AS kind FROM chunk WHERE document IS NOT NULL)
        SELECT c.id, length(c.document)::BIGINT AS chars FROM c LEFT JOIN l ON l.kind = c.kind AND l.kind <> '*'
        WHERE length(c.document) > coalesce(l.max_chars, (SELECT max_chars FROM l WHERE kind = '*'))""",
}
