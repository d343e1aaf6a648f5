"""The numbered queries of this subpackage and the SQL that states them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atomloom.llm.bpe import op5_bpe
from atomloom.llm.langid import op2_language_id
from atomloom.llm.media import op7_media_copies
from atomloom.llm.mixing import op4_mix_sources
from atomloom.llm.neardup import op6_near_duplicates
from atomloom.llm.packing import op11_pack_sequences
from atomloom.llm.phrases import op13_collocations
from atomloom.llm.quality import op3_quality
from atomloom.llm.sharding import op1_rendezvous_sharding
from atomloom.llm.toxicity import op10_toxicity
from atomloom.llm.warc import op9_warc
from atomloom.llm.wavelet import op8_token_files
from atomloom.llm.whitening import op12_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_rendezvous_sharding, op2_language_id, op3_quality, op4_mix_sources, op5_bpe, op6_near_duplicates, op7_media_copies, op8_token_files, op9_warc, op10_toxicity, op11_pack_sequences, op12_whitening, op13_collocations)}


#: SHA-1 in base 32: five hex digits (20 bits) give four characters.
_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
 array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(payload), ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p"""


#: Shingles as texts, exact similarities of all pairs that share one, and the transitive closure of the links.
_NEARDUP_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
f AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM f x JOIN f y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, g.b FROM reach r JOIN both_ways g ON r.seen = g.a),
c AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id"""


#: Pieces, words, runs of one to five words and their counts; a candidate at its lowest cut; what a longer one repeats goes.
_COLLOCATION_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, generate_series(1, 5) s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, unnest(generate_series(1, k - 1)) AS cut, ws FROM c),
both_sides AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:cut], ' ') AND x.k = cut JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ') AND y.k = len(ws) - cut JOIN t ON t.lang = cuts.lang),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM both_sides) WHERE first = 1),
inner_of AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer FROM c, generate_series(1, 5) s(i), generate_series(1, 5) e(j) WHERE i < j AND j <= k AND j - i + 1 < k GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inner_of i ON i.lang = low.lang AND i.phrase = low.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op13_collocations": _COLLOCATION_SQL, "op6_near_duplicates": _NEARDUP_SQL, "op9_warc": _WARC_SQL}
