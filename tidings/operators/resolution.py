"""Entity resolution: mentions against a vocabulary, with thresholds and required words; event scores; alert rules."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import fold_alert
from tidings.functions.values import closeness, weighted
from tidings.operators.joins import nearest

HIGH, LOW = 0.6, 0.35
# Codes of alert kinds and the words that mean them, in order of test; words of notices that are no alert.
ALERTS = (
    (35, ("طيران حربي", "مقاتلات حربية", "مقاتله حربيه", "مقاتلات حربيه")),
    (36, ("طيران استطلاعي", "طائره استطلاع", "مسيره", "مسير", "معم سر", "معمر سر")),
    (38, ("طيران مروحي", "مروحيه", "هليكوبتر", "apache", "ah-64", "كوترية")),
)
NOTICES = ("نرجو منكم ابلاغنا فورا", "عبر البوت الجديد", "tawasulra bot", "redalertlb twasol bot")
# A map card without any of these words bears the sender's address and both words of its warning.
CARD, CARD_KIND = ("redalert com lb", ("حيطة", "خبطة"), "حذر"), 36


def resolve(mentions: DataFrame, mention_id: str, mention: Column, dim: DataFrame, dim_id: str, name: Column, k: int = 5, required: dict[int, tuple[str, ...]] | None = None, high: float = HIGH, low: float = LOW) -> DataFrame:
    """(mention_id, matched_id, confidence, status): of the k nearest names the first decides, but for those that require a word, of which the mention must hold one in any case: matched, low_confidence, or unmatched with the score but no id."""
    best = nearest(mentions, mention_id, mention, dim, dim_id, name, k)
    text = mentions.select(F.col(mention_id).alias("_m"), F.lower(mention).alias("_text"))
    best = best.join(text, best[mention_id] == text["_m"])
    for id_, words in (required or {}).items():
        best = best.where((F.col(dim_id) != id_) | reduce(lambda a, b: a | b, (F.contains(F.col("_text"), F.lit(w)) for w in words)))
    first = best.groupBy(mention_id).agg(F.min_by(F.struct(F.col(dim_id).alias("id"), "score"), "rank").alias("b"))
    out = mentions.select(mention_id).join(first, mention_id, "left")
    score = F.col("b.score")
    status = F.when(score >= high, "matched").when(score >= low, "low_confidence").otherwise("unmatched")
    return out.select(mention_id, F.when(score >= low, F.col("b.id")).alias("matched_id"), F.coalesce(score, F.lit(0.0)).alias("confidence"), status.alias("status"))


def event_score(same_place_action: Column, days: Column, cosine: Column, window: int = 3) -> Column:
    """0.35 for the same place and action, 0.45 for the texts' cosine, 0.20 for closeness in days."""
    return weighted([(0.35, same_place_action.cast("double")), (0.45, cosine), (0.20, closeness(days, window))])


def score_tier(score: Column, high: float = 0.80, low: float = 0.50) -> Column:
    return F.when(score >= high, "merge").when(score >= low, "flag").otherwise("new")


def folded_alert_kind(folded: Column) -> Column:
    """alert_kind() of a text that is folded already: a column, since it is named once for each word."""

    def any_of(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(folded, fold_alert(F.lit(w)))
        return hit

    kind = F.when(any_of(NOTICES), F.lit(None).cast("int"))
    for code, words in ALERTS:
        kind = kind.when(any_of(words), F.lit(code))
    sender, either, word = CARD
    return kind.when(any_of([sender]) & any_of(either) & any_of([word]), F.lit(CARD_KIND))


def alert_kind(text: Column) -> Column:
    """The code of the first alert kind that a text has a word of, words of misread headers included, else that of a map card; null for notices and other texts."""
    # a lambda's variable, so that a long text is folded once and not for each word
    return F.get(F.transform(F.array(fold_alert(text)), folded_alert_kind), 0)


def place_ids(matches: Column, flat_id: Column) -> Column:
    """Distinct place ids from a list of matches, or from the flat form that older rows have."""
    listed = F.transform(F.filter(matches, lambda m: m["matched_village_id"].isNotNull()), lambda m: m["matched_village_id"])
    return F.array_distinct(F.coalesce(listed, F.when(flat_id.isNotNull(), F.array(flat_id)), F.array().cast("array<int>")))
