"""Scalar formatting functions."""

from pyspark.sql import Column, functions as F

from codelode.functions import text
from codelode.functions.paths import lookup
from codelode.lexicons import CHANGE_LABELS


def iso(ts: Column) -> Column:
    """ISO text of a timestamp, with microseconds only where there are any; free of time zones for TIMESTAMP_NTZ."""
    written = ts.cast("string")
    whole = F.replace(F.substring(written, 1, 19), F.lit(" "), F.lit("T"))
    fraction = F.when(written.contains("."), F.rpad(F.substring_index(written, ".", -1), 6, "0"))
    return F.concat(whole, F.coalesce(F.concat(F.lit("."), fraction), F.lit("")))


def age_months(first: Column, as_of: Column) -> Column:
    """Whole 30-day months between two instants; 0 without a start."""
    passed = as_of - first
    # an interval's parts share its sign, so whole days are the floor of their sum
    seconds = sum(
        (F.extract(F.lit(unit), passed) * size for unit, size in (("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))), F.lit(0)
    )
    days = F.extract(F.lit("DAY"), passed) + F.when(seconds < 0, -1).otherwise(0)
    # division cuts toward zero, as opposed to the floor of days
    return F.coalesce((days / 30).cast("int"), F.lit(0))


def _years(months: Column) -> Column:
    return F.floor(months / 12).cast("int").cast("string")


def _rest(months: Column) -> Column:
    return (months % 12).cast("string")


def age_display(months: Column) -> Column:
    return (
        F.when(months < 1, "< 1 mo")
        .when(months < 12, F.concat(months.cast("string"), F.lit(" mo")))
        .otherwise(F.concat(_years(months), F.lit("+ yr")))
    )


def age_long(months: Column) -> Column:
    years = F.concat(_years(months), F.when(months >= 24, " years").otherwise(" year"))
    rest = F.when(months % 12 != 0, F.concat(F.lit(", "), _rest(months), F.lit(" months"))).otherwise("")
    return (
        F.when(months < 1, "< 1 month")
        .when(months < 12, F.concat(months.cast("string"), F.lit(" months")))
        .otherwise(F.concat(years, rest))
    )


def format_duration(months: Column) -> Column:
    rest = F.when(months % 12 != 0, F.concat(F.lit(" "), _rest(months), F.lit(" mo"))).otherwise("")
    return (
        F.when(months < 1, "< 1 mo")
        .when(months < 12, F.concat(months.cast("string"), F.lit(" mo")))
        .otherwise(F.concat(_years(months), F.lit(" yr"), rest))
    )


def format_bytes(size: Column) -> Column:
    """1024-based size with one decimal, halves rounded to even."""
    value = size.cast("double")

    def shown(power, unit):
        return F.format_string(f"%.1f {unit}", F.bround(value / float(1024**power), 1))

    out = None
    for power, unit in enumerate(["B", "KB", "MB", "GB"]):
        fits = value < float(1024 ** (power + 1))
        out = F.when(fits, shown(power, unit)) if out is None else out.when(fits, shown(power, unit))
    return out.otherwise(shown(4, "TB"))


def repo_hash(head_sha: Column, commit_count: Column) -> Column:
    """State fingerprint; empty where there is no head commit."""
    digest = F.sha2(F.concat(head_sha, F.lit(":"), commit_count.cast("string")), 256)
    return F.coalesce(F.substring(digest, 1, 16), F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def clean_remote_url(url: Column) -> Column:
    short = F.replace(F.replace(url, F.lit("git@github.com:"), F.lit("github.com/")), F.lit(".git"), F.lit(""))
    return F.when(url != "", F.when(short.startswith("https://"), F.substring(short, 9, 1 << 30)).otherwise(short))


def subject(message: Column) -> Column:
    return text.first_line(text.strip(message))


def sha8(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def truncate_diff(diff: Column, n: int = 50) -> Column:
    """First lines of a diff, and how many more there are; lines are counted only where it is cut."""
    head = text.head_lines(diff, n)
    more = F.concat(F.lit("\n... ("), (text.line_count(diff) - n).cast("string"), F.lit(" more lines)"))
    return F.when(F.octet_length(head) == F.octet_length(diff), diff).otherwise(F.concat(head, more))


def change_label(change_type: Column) -> Column:
    return F.coalesce(lookup(change_type, CHANGE_LABELS), F.lit("Changed"))


def ellipsize(s: Column, width: int = 100) -> Column:
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 3), F.lit("..."))).otherwise(s)


def story_date(ts: Column) -> Column:
    """Date part of an ISO text; the first ten characters if it does not parse."""
    iso_form = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?\z"
    # the written date, not its UTC day: the offset is dropped before the parse
    local = F.regexp_replace(ts, r"(Z|(?<=:\d{2})[+-]\d{2}:\d{2})\z", "")
    parsed = F.date_format(F.try_to_timestamp(F.when(ts.rlike(iso_form), local)), "yyyy-MM-dd")
    return F.when(F.coalesce(ts, F.lit("")) == "", "unknown").otherwise(F.coalesce(parsed, F.substring(ts, 1, 10)))


def domain_title(domain: Column) -> Column:
    return F.initcap(F.replace(domain, F.lit("-"), F.lit(" ")))


def language_list(shares: Column) -> Column:
    """``name (n%), ...`` from an ordered array of (language, pct) structs."""
    named = F.transform(shares, lambda s: F.concat(s["language"], F.lit(" ("), s["pct"].cast("string"), F.lit("%)")))
    return F.when(F.size(shares) > 0, F.array_join(named, ", ")).otherwise("Unknown")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
