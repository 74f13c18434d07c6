"""String, path and token expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Runs of letters between word boundaries of Unicode words.
LETTERS = r"(?U)\b[a-zA-Z]+\b"


def default_stopwords(spark: SparkSession) -> list[str]:
    """Spark's own English stop words."""
    return list(spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"))


def slashes(path: Column) -> Column:
    """A path with forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def safe_name(text: Column) -> Column:
    """A file name of word characters only (F2)."""
    return F.regexp_replace(text, r"(?U)[^\w]", "_")


def derive_subject(file: Column, group: Column | None = None) -> Column:
    """The subject of a file (F1): the last segment of its group, ``unknown`` for a null group;
    without a group column its parent folder. What is blank is ``default``."""
    def clean(x: Column) -> Column:
        kept = F.trim(F.regexp_replace(x, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". "))
        return F.when(kept != "", kept).otherwise("default")

    if group is not None:
        return clean(F.try_element_at(F.split(F.rtrim(slashes(F.coalesce(group.cast("string"), F.lit("unknown"))), F.lit("/")), "/"), F.lit(-1)))
    parts = F.split(F.rtrim(slashes(file), F.lit("/")), "/")
    return clean(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))


def tokens(text: Column, stopwords: Sequence[str] = (), least: int = 2) -> Column:
    """Lower-case words of ASCII letters without stop words and short words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTERS), F.lit(0)), F.lower)
    # A list of literals is looked up as a set.
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(list(stopwords)) if stopwords else F.length(w) >= least)


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a space."""
    n = F.size(words)
    return F.when(n >= 2, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Words by white space (F4); null for null."""
    return F.regexp_count(text, F.lit(r"\S+"))


def integers(text: Column) -> Column:
    """All integers in a text, with their signs."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda s: s.cast("int"))


def undecorated(text: Column) -> Column:
    """A label without list brackets and quotes."""
    return F.trim(text, F.lit("[]'\""))


def split_key(key: Column) -> tuple[Column, Column]:
    """Subject and path of a request key (F7), with the older ``assets/player_x/`` form."""
    old = r"^(?:.*/)?assets/(player_[^/]+)/"
    has = F.contains(key, F.lit("::"))
    subject = F.when(has, F.split_part(key, F.lit("::"), F.lit(1))).otherwise(F.nullif(F.regexp_extract(key, old, 1), F.lit("")))
    path = F.when(has, F.substring(key, F.instr(key, F.lit("::")) + 2, F.length(key))).otherwise(key)
    return subject, slashes(path)


def build_key(subject: Column, path: Column) -> Column:
    """A request key (F8)."""
    return F.concat(subject, F.lit("::"), slashes(path))


def mime_type(path: Column) -> Column:
    """Video for .mp4, else JPEG image."""
    return F.when(F.lower(path).endswith(".mp4"), "video/mp4").otherwise("image/jpeg")


def labelled_block(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Lines ``label: value``, blanks as ``Unknown``."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit("Unknown"))) for label, value in pairs])


def listed(items: Column) -> Column:
    """Items joined by a semicolon."""
    return F.array_join(items, "; ")


def unique_names(names: Sequence[str], most: int = 31) -> list[str]:
    """Sheet names cut to ``most`` characters and made distinct by a suffix."""
    taken: set[str] = set()
    out = []
    for name in names:
        one, k = name[:most], 2
        while one.lower() in taken:
            suffix = f"_{k}"
            one, k = name[: most - len(suffix)] + suffix, k + 1
        taken.add(one.lower())
        out.append(one)
    return out


def slide_index(file: Column) -> Column:
    """The number of a slide file, null for other files."""
    return F.nullif(F.regexp_extract(F.lower(file), r"^(\d+)-slide-.*\.(?:png|jpg|jpeg)$", 1), F.lit("")).cast("int")


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Whether the suffix is one of ``extensions``, whatever its case (P5); false for null."""
    return F.coalesce(F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0)).isin([e.lower() for e in extensions]), F.lit(False))
