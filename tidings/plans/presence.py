"""The gate of present categories over whole documents."""

from pyspark.sql import functions as F

from tidings.operators import presence
from tidings.plans.registry import query
from tidings.sources.tables import table as t

_PHRASES = (
    "قصف قرب المستشفى", "أصيبت المدرسة بالقرب من السوق", "لا أضرار في الكنيسة", "الطريق العام", "قطع الطريق والجسر", "دورية للجيش مع مواكبة", "استهدف الجيش مع مواكبة",
    "نقل إلى المستشفى", "قسم الطوارئ", "حضر الدفاع المدني وفرق الإنقاذ", "غارة على بلدة ميس", "مبنى البلدية في بلدة ميس", "سيارة على الطريق", "هدوء", "سيارة إسعاف أمام المسجد",
)
_KEYS = (*presence.CATEGORIES, "unknown")


def _any(text: str, group: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in presence.TERMS[group]) + ")"


def _either(group: str) -> str:
    return f"({_any('span', group)} OR {_any('post', group)})"


_FIRST = " ".join(f"WHEN contains(post, '{w}') THEN '{w}'" for w in presence.TERMS["organization"])


@query(f"""WITH d AS (SELECT doc_id, {list(_PHRASES)} AS ph, {list(_KEYS)} AS ks, coalesce(text, '') AS body FROM documents),
 m AS (SELECT doc_id, ph[doc_id % 15 + 1] || ' ' || ph[(doc_id * 5 + 3) % 15 + 1] || chr(10) || body AS post, ks[doc_id % 16 + 1] AS k1, ks[doc_id // 16 % 16 + 1] AS k2, '  ' || ph[doc_id * 3 % 15 + 1] || ' ' AS s1, ph[doc_id * 7 % 15 + 1] AS s2 FROM d),
 c AS (SELECT doc_id, post, 1 AS n, k1 AS k, CASE WHEN doc_id % 4 <> 0 THEN trim(s1) WHEN k1 = k2 AND doc_id % 3 = 0 THEN s2 ELSE '' END AS span FROM m WHERE k1 <> 'unknown' UNION ALL SELECT doc_id, post, 2, k2, CASE WHEN doc_id % 3 = 0 THEN s2 ELSE '' END FROM m WHERE k2 <> k1 AND k2 <> 'unknown'),
 e AS (SELECT *, CASE WHEN span <> '' THEN span ELSE post END AS shown, k IN {presence.BUILDINGS} AS b FROM c WHERE doc_id % 17 <> 0),
 f AS (SELECT * FROM e WHERE NOT CASE WHEN b AND {_either("unharmed")} THEN true WHEN b AND {_any("span", "near")} THEN NOT {_any("span", "harm")}
  WHEN k = 'road_bridge' THEN {_any("span", "road")} AND NOT {_any("span", "road_harm")} WHEN k = 'lebanese_army' THEN {_either("escort")} AND NOT {_either("army_harm")}
  WHEN k = 'emergency_civil_defense' THEN {_either("ward")} AND NOT {_either("rescuer")}
  WHEN k = 'municipality' THEN {_any("shown", "locality")} AND {_any("shown", "attack")} AND NOT {_any("shown", "town_hall")} OR NOT {_either("town_hall")} AND {_any("span", "locality")}
  WHEN k = 'vehicles' THEN NOT {_either("vehicle")} WHEN k = 'hospital' THEN {_either("admission")} AND NOT {_either("harm")} ELSE false END),
 o AS (SELECT doc_id, post, CASE {_FIRST} END AS w FROM m WHERE doc_id % 17 <> 0),
 a AS (SELECT doc_id, n, k, span FROM f UNION ALL SELECT doc_id, 3, 'emergency_civil_defense', trim(substr(post, greatest(strpos(post, w) - 20, 1), strpos(post, w) + length(w) + 40 - greatest(strpos(post, w) - 20, 1)), ' ' || chr(10) || chr(9) || chr(11) || chr(12) || chr(13))
  FROM o WHERE w IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM f WHERE k = 'emergency_civil_defense'))
 SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'malformed' ELSE 'ok' END AS status, coalesce(string_agg(k || '=' || span, '|' ORDER BY n), '') AS present FROM documents LEFT JOIN a USING (doc_id) GROUP BY doc_id""")
def presence_gate(spark, sf):
    """Answers on documents, some malformed, with unknown, repeated and unproven categories; one phrase or two before each text."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    k = F.col("doc_id")
    post = F.concat(pick(_PHRASES, k), F.lit(" "), pick(_PHRASES, k * 5 + 3), F.lit("\n"), F.coalesce("text", F.lit("")))
    one, two = pick(_KEYS, k), pick(_KEYS, F.floor(k / 16))
    proof = lambda key, span: F.struct(key.alias("category_key"), span.alias("evidence_span"))
    first = F.when(k % 4 != 0, F.array(proof(one, F.concat(F.lit("  "), pick(_PHRASES, k * 3), F.lit(" "))), proof(one, F.lit("second"))))
    second = F.when(k % 3 == 0, F.array(proof(two, pick(_PHRASES, k * 7))))
    none = F.array().cast("array<struct<category_key: string, evidence_span: string>>")
    raw = F.to_json(F.struct(F.array(one, two, one).alias("categories_present"), F.concat(F.coalesce(first, none), F.coalesce(second, none), F.array(proof(F.lit("unknown"), F.lit("x")))).alias("category_evidence")))
    m = t(spark, sf, "documents").select("doc_id", post.alias("post"), F.when(k % 17 == 0, "{oops").otherwise(raw).alias("raw"))
    out = presence.gate(m, "doc_id", "post", "raw")
    return out.select("doc_id", "status", F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["category_key"], e["evidence_span"])), "|").alias("present"))
