"""Names: of chunks, manifests and spool folders, and parsers of the small texts around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the naming format.
SEPARATOR = "%2F"
LONGEST, HALF = 230, 104


def chunk_name(fp: Column) -> Column:
    """Both halves of a fingerprint as 16 hex digits, joined by an escaped slash."""
    return F.concat(F.substring(fp, 1, 16), F.lit(SEPARATOR), F.substring(fp, 17, 16))


def chunk_name_fp(name: Column) -> Column:
    """The fingerprint a chunk name stands for; null if it is none."""
    return F.when((F.length(name) == 35) & name.rlike("^[0-9a-f]{16}%2F[0-9a-f]{16}$"), F.concat(F.substring(name, 1, 16), F.substring(name, 20, 16)))


def percent_encoded(text: Column) -> Column:
    """Percent-encoding that keeps letters, digits and !-_.*'()."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def short_hash(text: Column, digits: int = 4) -> Column:
    """The first hex digits of the md5."""
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def fitted(name: Column) -> Column:
    """Names of 230 bytes or more keep 104 bytes at either end around their hash, 240 in all; a character that is cut becomes U+FFFD."""
    data = name.cast("binary")
    ends = [F.make_valid_utf8(F.substring(data, at, HALF).cast("string")) for at in (1, -HALF)]
    return F.when(F.octet_length(name) >= LONGEST, F.concat(ends[0], F.md5(data), ends[1])).otherwise(name)


def manifest_name(host: Column, path: Column) -> Column:
    return fitted(percent_encoded(F.concat(short_hash(host), F.lit("-chunkvault:"), host, F.lit(":"), short_hash(path), F.lit("/"), path)))


#: Printable ASCII characters that a mangled name holds as they are, besides those that no URL encodes.
PLAIN = "!\"$&'()+,:;<=>?@[\\]^`{|}~"


def mangled(path: Column) -> Column:
    """A path as one file name: # for slashes; control characters, #, % and the bytes of non-ASCII characters as %XX."""
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit(" "))
    for char in PLAIN:
        out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return fitted(F.replace(out, F.lit("%2F"), F.lit("#")))


def unmangled(name: Column) -> Column:
    """The path of a mangled name; null where the name was cut."""
    slashed = F.replace(F.replace(name, F.lit("#"), F.lit("/")), F.lit("+"), F.lit("%2B"))
    return F.when(F.octet_length(name) <= LONGEST, F.try_url_decode(slashed))


def spool_source(spool: Column) -> Column:
    """The file that a spool folder .../<mangled path>/<device.inode> is for."""
    return unmangled(F.element_at(F.split(spool, "/"), -2))


def canonical(path: Column) -> Column:
    """An absolute path without empty, . and .. parts."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def source_kind(uri: Column) -> Column:
    """Which reader a URI goes to."""
    kinds = F.when(uri.rlike("^https?://"), "http").when(uri.startswith("s3://"), "s3").when(uri.startswith("replica://"), "replica")
    return kinds.when(uri.startswith("file://"), "file").otherwise("path")


def s3_parts(uri: Column) -> tuple[Column, Column, Column]:
    """Bucket, region and key of s3://bucket.region[.endpoint]/key."""
    rule = r"^s3://([^./]+)\.([^/]+)/(.*)$"
    return tuple(F.regexp_extract(uri, rule, i) for i in (1, 2, 3))


# Regions whose endpoints follow from their names.
KNOWN_REGIONS = (
    "us-east-1", "us-east-2", "us-west-1", "us-west-2", "ca-central-1", "sa-east-1", "eu-central-1", "eu-west-1", "eu-west-2", "eu-west-3", "eu-north-1", "eu-south-1",
    "ap-south-1", "ap-southeast-1", "ap-southeast-2", "ap-northeast-1", "ap-northeast-2", "ap-northeast-3", "ap-east-1", "me-south-1", "af-south-1",
)


def region_name(region: Column, given: Column) -> Column:
    """The name of a region: all of it where an endpoint is given or the region is known, else what stands before the first dot."""
    return F.when(given.isNotNull() | region.isin(*KNOWN_REGIONS), region).otherwise(F.get(F.split(region, r"\.", 2), F.lit(0)))


def endpoint(region: Column, given: Column) -> Column:
    """The endpoint of a region: as given, the known one of a standard region, what follows name. in a custom one, or the bare name as a host."""
    parts = F.split(region, r"\.", 2)
    known = F.when(region.isin(*KNOWN_REGIONS), F.concat(F.lit("https://s3."), region, F.lit(".amazonaws.com")))
    return F.coalesce(given, known, F.concat(F.lit("https://"), F.coalesce(F.get(parts, F.lit(1)), region)))


def birth_tick(stat: Column) -> Column:
    """Field 22 of a process's stat line; the command may hold spaces and parentheses."""
    rest = F.substring_index(stat, ")", -1)
    return F.get(F.split(F.trim(rest), " "), F.lit(19)).cast("long")


def falsy(param: Column) -> Column:
    """Whether a parameter means no: it begins with 0, f or n, or is off, in either case."""
    return F.lower(F.substring(param, 1, 1)).isin("0", "f", "n") | (F.lower(param) == "off")


def bool_param(param: Column, default: bool) -> Column:
    return F.coalesce(~falsy(param), F.lit(default))


def ns_timestamp(s: Column, ns: Column) -> Column:
    return F.format_string("%d.%09d", s, F.greatest(F.least(ns, F.lit(999_999_999)), F.lit(0)))


def backoff_ms(base: int, attempt: Column, jitter: Column | None = None) -> Column:
    """The wait before a further attempt: ten times longer each time, times the jitter, 1 to 2."""
    wait = F.lit(base) * F.pow(F.lit(10), attempt)
    return (wait if jitter is None else wait * jitter).cast("long")


def lock_sleep_ms(attempt: Column) -> Column:
    """The most that a waiter for a lock sleeps: a tenth of a millisecond, doubled every fourth attempt, up to ten."""
    return F.least(F.lit(10.0), F.lit(0.1) * F.pow(F.lit(2.0), F.floor(attempt / 4)))


def age_s(now: Column, then: Column) -> Column:
    """Seconds since then; null where then lies ahead."""
    age = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(age >= 0, age)


def instance_id(boot: Column, boot_id: Column) -> Column:
    return F.concat_ws(".", boot.cast("string"), boot_id.cast("string"))


def process_id(pid: Column, birth: Column) -> Column:
    return F.concat_ws(".", pid.cast("string"), birth.cast("string"))


def file_key(device: Column, inode: Column) -> Column:
    return F.concat_ws(".", device.cast("string"), inode.cast("string"))


def scratch_name(pid: Column, micros: Column, nth: Column, draw: Column) -> Column:
    """A name that no other scratch file has."""
    return F.concat_ws(".", *[c.cast("string") for c in (pid, micros, nth, draw)])


def candidate_ids(ts: Column) -> Column:
    """Instance times to try, closest first."""
    return F.array(ts, ts - 1, ts + 1, ts - 2, ts + 2)
