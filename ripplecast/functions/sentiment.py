"""Lexicon sentiment: a fold over a text's tokens, on the map side."""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes in report order.
SENTIMENTS = ["Negative", "Neutral", "Positive"]

# Class bounds, score normalisation, weight of a negated word and its reach.
POSITIVE_FROM = 0.05
NEGATIVE_TO = -0.05
NORMALISER = 15.0
NEGATED = -0.74
REACH = 3

# What a booster adds, and its share from one, two and three tokens before; what
# capitals add; weights before and after "but"; exclamation and question marks.
BOOST = 0.293
FADING = [1.0, 0.95, 0.9]
CAPITALS = 0.733
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MOST_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96

# Words that deny, strengthen, weaken and contrast.
NEGATORS = ["not", "never", "no", "none", "nor", "nothing", "neither", "nowhere", "cannot", "without"]
STRONGER = [
    "absolutely", "completely", "considerably", "deeply", "enormously", "entirely", "especially", "exceptionally",
    "extremely", "fully", "greatly", "highly", "hugely", "incredibly", "intensely", "more", "most", "particularly",
    "quite", "really", "remarkably", "so", "thoroughly", "totally", "tremendously", "truly", "utterly", "very",
]
WEAKER = ["almost", "barely", "hardly", "less", "little", "marginally", "partly", "scarcely", "slightly", "somewhat"]
CONTRASTS = ["but"]

#: A lexicon becomes a literal of the plan, so its size is checked.
MOST_WORDS = 100_000


@dataclass(frozen=True)
class Rules:
    """Words that change the valence of others; a contraction with "n't" denies too."""

    negators: Sequence[str] = tuple(NEGATORS)
    boosters: Mapping[str, float] = field(
        default_factory=lambda: {**dict.fromkeys(STRONGER, BOOST), **dict.fromkeys(WEAKER, -BOOST)}
    )
    contrasts: Sequence[str] = tuple(CONTRASTS)


def sentiment_class(compound: Column) -> Column:
    return (
        F.when(compound >= POSITIVE_FROM, F.lit("Positive"))
        .when(compound <= NEGATIVE_TO, F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )


def mean_valences(lexicon: DataFrame) -> DataFrame:
    """(word, valence): lower-case words, a repeated one with the mean of its valences.

    The words are dealt out first, since Spark evaluates the rows of a literal lexicon while it plans:
    ``lower`` there fills tables for all of Unicode, some 3 GB of allocations at once, on the driver.
    """
    known = lexicon.where("word is not null and valence is not null").hint("rebalance")
    return known.groupBy(F.lower("word").alias("word")).agg(F.avg("valence").alias("valence"))


def valences(lexicon: DataFrame, most: int = MOST_WORDS) -> dict[str, float]:
    """The lexicon's words with their valences. Raises beyond ``most`` words."""
    rows = mean_valences(lexicon).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} words")
    return {row["word"]: row["valence"] for row in rows}


def _looked_up(words: Mapping[str, float]):
    """A lookup of a word in literal maps of about four words each, chosen by a checksum."""
    size = max(1, len(words) // 4)
    cells: list[list[Column]] = [[] for _ in range(size)]
    for word, value in sorted(words.items()):
        cells[zlib.crc32(word.encode()) % size] += [F.lit(word), F.lit(float(value))]
    table = F.array(*[F.create_map(*cell).cast("map<string,double>") for cell in cells])

    def find(word: Column) -> Column:
        place = F.pmod(F.crc32(word.cast("binary")), F.lit(size)).cast("int")
        return F.try_element_at(F.get(table, place), word)

    return find


def with_compound(
    posts: DataFrame, words: Mapping[str, float], name: str = "compound", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """Add the compound score of a text: 0 without known words, between -1 and 1.

    Tokens lose the punctuation around them unless they hold nothing else. A known word is
    strengthened or weakened by boosters among the three tokens before it, less by farther ones;
    it is turned by a negator among them; capitals in a text that is not all capitals stress it.
    Words before a contrast count half, words after it one and a half times. Exclamation and
    question marks move the sum away from 0. All of it is one pass over the tokens: the state
    holds the sum, the weight, the last three boosters and how long ago a negator stood.
    """
    valence, boost = _looked_up(words), _looked_up(rules.boosters)
    bare = r"^\p{Punct}++(?=.*[^\p{Punct}])|(?<=[^\p{Punct}])\p{Punct}+$"
    spoken = F.transform(
        F.filter(F.split(F.col(text), r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, bare, "")
    )
    loud = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    stressed = F.exists("_spoken", loud) & F.exists("_spoken", lambda w: ~loud(w))

    def described(word: Column) -> Column:
        low = F.lower(word)
        stress = F.when(F.col("_stressed") & loud(word), F.lit(CAPITALS)).otherwise(F.lit(0.0))
        known, boosted = valence(low), boost(low)
        return F.struct(
            (known + F.signum(known) * stress).alias("v"),
            F.when(known.isNull(), boosted + stress).alias("b"),
            (low.isin(list(rules.negators)) | low.endswith("n't")).alias("denies"),
            low.isin(list(rules.contrasts)).alias("turns"),
        )

    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("sum"), F.lit(1.0).alias("weight"), zero.alias("b1"), zero.alias("b2"), zero.alias("b3"),
        F.lit(REACH + 1).alias("since"),
    )

    def step(state: Column, token: Column) -> Column:
        boosts = sum((state[f"b{k + 1}"] * F.lit(share) for k, share in enumerate(FADING)), F.lit(0.0))
        value = token["v"] + F.signum(token["v"]) * boosts
        value = value * F.when(state["since"] <= REACH, F.lit(NEGATED)).otherwise(F.lit(1.0))
        turned = token["turns"] & (state["weight"] == 1.0)
        return F.struct(
            F.when(turned, state["sum"] * F.lit(BEFORE_BUT))
            .otherwise(state["sum"] + F.coalesce(value, zero) * state["weight"])
            .alias("sum"),
            F.when(turned, F.lit(AFTER_BUT)).otherwise(state["weight"]).alias("weight"),
            F.coalesce(token["b"], zero).alias("b1"), state["b1"].alias("b2"), state["b2"].alias("b3"),
            F.when(token["denies"], F.lit(1)).otherwise(F.least(state["since"] + 1, F.lit(REACH + 1))).alias("since"),
        )

    exclaimed = F.least(F.regexp_count(F.col(text), F.lit("!")), F.lit(MOST_EXCLAMATIONS)) * F.lit(EXCLAMATION)
    asked = F.regexp_count(F.col(text), F.lit("[?]"))
    questioned = (
        F.when(asked > MOST_QUESTIONS, F.lit(MANY_QUESTIONS)).when(asked > 1, asked * F.lit(QUESTION)).otherwise(zero)
    )
    side = F.when(F.abs("_sum") < 1e-9, zero).otherwise(F.signum("_sum"))  # what cancels out has no side
    total = F.col("_sum") + side * (exclaimed + questioned)
    return (
        posts.withColumn("_spoken", spoken)
        .withColumn("_stressed", stressed)
        .withColumn("_tokens", F.transform("_spoken", described))
        .withColumn("_sum", F.coalesce(F.aggregate("_tokens", start, step)["sum"], zero))
        .withColumn("_sum", F.coalesce(total, zero))
        .withColumn(name, F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + F.lit(NORMALISER)))
        .drop("_spoken", "_stressed", "_tokens", "_sum")
    )


def sentiment_score(
    posts: DataFrame, lexicon: DataFrame, key: str = "tweet_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """(key, compound) of every post; ``lexicon`` has columns word, valence."""
    scored = with_compound(posts.select(key, F.col(text).alias("text")), valences(lexicon), "compound", "text", rules)
    return scored.select(key, "compound")
