"""Vector expressions on array columns; all sums are in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A norm up to this counts as zero.
TINY = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unit(v: Column) -> Column:
    """The vector over its norm; as it is when that is tiny; null for null or with a null component."""
    return let(doubles(v), lambda w: let(norm(w), lambda n: F.when(n > TINY, F.transform(w, lambda x: x / n)).otherwise(w)))


def scaled(v: Column, by: Column) -> Column:
    return let(by, lambda b: F.transform(doubles(v), lambda x: x * b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either is missing or of tiny norm."""
    na, nb = norm(a), norm(b)
    return F.when((na > TINY) & (nb > TINY), dot(a, b) / (na * nb)).otherwise(0.0)


def fold_pitch_bins(pcp: Column) -> Column:
    """36 bins to 12 by adding up threes, then to length one."""
    return unit(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.aggregate(F.slice(pcp, i * 3 + 1, F.lit(3)), F.lit(0.0), lambda s, x: s + x)))


def spread_pitch_bins(chroma: Column) -> Column:
    """12 bins to 36 with two zeros after each, then to length one."""
    return unit(F.flatten(F.transform(doubles(chroma), lambda x: F.array(x, F.lit(0.0), F.lit(0.0)))))


def profile_chain(fine: Column, coarse: Column, templates: Column, n: int, temperature: float = 0.5) -> Column:
    """Template probabilities of the first profile there is: 36 bins (folded to 12), else 12 bins, else zeros."""
    of = lambda p: template_softmax(p, templates, temperature)
    return F.when(F.size(fine) == 36, of(fold_pitch_bins(doubles(fine)))).when(F.size(coarse) == 12, of(doubles(coarse))).otherwise(F.array_repeat(F.lit(0.0), n))


def one_hot(place: Column, size: int) -> Column:
    return F.when(place.isNotNull(), F.array(*[(place == i).cast("int") for i in range(size)]))


def template_softmax(profile: Column, templates: Column, temperature: float = 0.5) -> Column:
    """How alike a profile is to each of the templates: a softmax over the cosines."""
    raised = F.transform(templates, lambda t: F.exp(cosine(profile, t) / temperature))
    return let(raised, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))
