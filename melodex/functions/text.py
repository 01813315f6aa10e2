"""Text expressions of a catalogue: ids, cleaning, keyword tags, parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

ID_LENGTH = 50
# Texts that stand for nothing.
NOTHING = ("", "nan", "none")


def make_song_id(title: Column, artist: Column) -> Column:
    """Lower-case title and artist; what is no letter, number or underscore becomes one; at most 50 characters."""
    return F.substring(F.regexp_replace(F.lower(F.concat_ws("_", title, artist)), r"[^\p{L}\p{N}_]", "_"), 1, ID_LENGTH)


def blank(c: Column) -> Column:
    """Is it null, empty or a text that stands for nothing?"""
    return F.coalesce(F.lower(F.trim(c)).isin(*NOTHING), F.lit(True))


def null_tokens(c: Column, instead: str | None = None) -> Column:
    return F.when(blank(c), F.lit(instead)).otherwise(F.trim(c))


def parse_clip_start(c: Column, default: int = 15) -> Column:
    """Whole seconds, not below zero; the default for null, text and infinities."""
    n = F.trim(c).try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 1e9)
    return F.when(ok, F.greatest(F.lit(0), F.when(ok, n).otherwise(0.0).cast("int"))).otherwise(default)


def clean_lyrics(c: Column) -> Column:
    """Without a trailing number and Embed, a first line that ends in lyrics, or more than two line feeds together."""
    t = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\d+Embed$", "")
    t = F.regexp_replace(t, r"(?i)\A[^\n]*lyrics(?:\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def lyrics_missing(c: Column) -> Column:
    return (F.coalesce(F.trim(c), F.lit("")) == "").cast("int")


def mood_hits(low: Column, words: list[str]) -> Column:
    """Non-overlapping occurrences of the words, one after another, in a lower-case text."""
    one = lambda w: (F.char_length(low) - F.char_length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    return sum((one(w) for w in words), F.lit(0.0)).cast("int")


# The keywords of each mood, romanised and Devanagari.
MOODS = {
    "devotional": [
        "khuda", "rab", "allah", "khwaja", "maula", "rehmat", "ibaadat", "sajda", "bandagi", "karam", "noor", "dargah",
        "kalandar", "mast qalandar", "ishwar", "bhagwan", "prabhu", "hari om", "bhakti", "aarti", "sufiyana", "rooh",
        "khudaya", "meherbaan", "duaa", "namaz", "haq", "manzil-e-noor", "ख़ुदा", "खुदा", "रब", "अल्लाह", "मौला", "ईश्वर",
        "भगवान", "प्रभु", "इबादत", "करम", "नूर", "दुआ", "भक्ति", "आरती",
    ],
    "romantic": [
        "pyaar", "pyar", "ishq", "mohabbat", "dilbar", "mehbooba", "sanam", "dilruba", "chahat", "prem", "deewana",
        "deewani", "dil", "aashiqui", "jaana", "mehboob", "dildaar", "yaariyan", "wajood", "प्यार", "इश्क़", "मोहब्बत",
        "दिल", "आशिकी", "जाना", "महबूब",
    ],
    "sad_longing": [
        "judaai", "judai", "tanhai", "tanhaai", "gham", "dard", "aansu", "bewafa", "bichadna", "tadap", "viraha", "dukh",
        "akela", "akeli", "bichhad", "rulaana", "yaad", "khoya", "kho gaya", "bujh gaya", "जुदाई", "तन्हाई", "ग़म", "गम",
        "दर्द", "आंसू", "बेवफा", "तड़प", "दुख", "अकेला", "याद",
    ],
    "celebratory_party": [
        "party", "naach", "jhoom", "masti", "hungama", "dance", "shaadi", "baaraat", "disco", "saturday", "high rated",
        "chull", "thumka", "balle balle", "gabru", "nasha", "chashma", "पार्टी", "नाच", "झूम", "मस्ती", "हंगामा", "शादी",
        "बारात",
    ],
}


def mood_tag(text: Column, words: dict[str, list[str]] = MOODS) -> Column:
    """The tag with the most hits; null when none has any, or two have as many."""
    names = F.array(*map(F.lit, words))

    def tagged(hits: Column) -> Column:
        def of(top: Column) -> Column:
            single = F.size(F.filter(hits, lambda h: h == top)) == 1
            return F.when((top > 0) & single, F.element_at(names, F.array_position(hits, top).cast("int")))

        return let(F.array_max(hits), of)

    return let(F.lower(text), lambda low: let(F.array(*[mood_hits(low, w) for w in words.values()]), tagged))


def normalise_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"^\s+|\s+$", "")


def parse_year(c: Column) -> Column:
    return F.substring(c, 2, 4).try_cast("int")


def grade_from_match(match: Column) -> Column:
    return F.when(match >= 0.4, 2).when(match >= 0.1, 1).otherwise(0)


# What a description says of a work, of a song, of a recording, and what that counts.
STRONG, WEAK, PENALTY = ("composed by", "written by", "written and composed"), ("song", "single", "soundtrack", "album"), ("vocal track",)


def record_score(description: Column, artist: Column) -> tuple[Column, Column]:
    """Score of a candidate's description, and whether it is accepted at all."""
    d, a = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(artist, F.lit("")))
    some = lambda words: d.rlike("|".join(words))
    by = (a != "") & d.contains(a)
    score = some(STRONG).cast("int") * 5 + some(WEAK).cast("int") * 2 - some(PENALTY).cast("int") * 3 + by.cast("int")
    return score, some(STRONG) | (some(WEAK) & by)
