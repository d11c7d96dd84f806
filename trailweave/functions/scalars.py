"""Scalar functions of the evidence model, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Remote-access services by port and by logon type, protocol names by port.
SERVICE_BY_PORT = {3389: "rdp", 445: "smb"}
SERVICE_BY_LOGON_TYPE = {"10": "rdp", "3": "smb"}
PROTOCOL_BY_PORT = {3389: "rdp", 445: "smb", 139: "netbios-ssn", 88: "kerberos", 53: "dns", 80: "http", 443: "https", 389: "ldap", 636: "ldaps", 135: "msrpc", 5985: "winrm", 5986: "winrm"}


def _lookup(key: Column, table: dict) -> Column:
    found = F.lit(None).cast("string")
    for k, v in table.items():
        found = F.when(key == F.lit(k), F.lit(v)).otherwise(found)
    return found


def utc_ts(text: Column) -> Column:
    """An ISO-8601 text as a timestamp; text without an offset means UTC (under a UTC session), junk gives null."""
    return F.try_to_timestamp(text)


_BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_MAPPED = rf"^(?:{_BLANKS})?::[fF]{{4}}:({_V4})(?:{_BLANKS})?$"


def canonical_ip(value: Column) -> Column:
    """Trimmed, IPv4-mapped IPv6 as IPv4, IPv6 compressed in lower case; null, '' and '-' unchanged, invalid text trimmed only."""
    plain = F.regexp_replace(value, f"^{_BLANKS}|{_BLANKS}$", "")
    mapped = F.regexp_extract(value, _MAPPED, 1)  # the usual form of mapped addresses; all others take the long way, with the same result
    long_way = _let(plain, lambda text: F.coalesce(_ipv6(text), text))
    return F.when(value.isNull() | value.isin("", "-"), value).when(~F.contains(value, F.lit(":")), plain).when(mapped != "", mapped).otherwise(long_way)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _hextets(v4: Column) -> Column:
    """The last two groups of an IPv6 address that ends in an IPv4 one."""
    o = F.transform(F.split(v4, r"\."), lambda x: x.cast("int"))
    return F.lower(F.concat(F.conv((o[0] * 256 + o[1]).cast("string"), 10, 16), F.lit(":"), F.conv((o[2] * 256 + o[3]).cast("string"), 10, 16)))


def _ipv6(text: Column) -> Column:
    """The canonical text of an IPv6 address (a mapped one as IPv4), null for any other text."""
    scope = F.regexp_extract(text, "^[^%]+(%[^%]+)$", 1)
    base = F.lower(F.split_part(text, F.lit("%"), F.lit(1)))
    tail = F.regexp_extract(base, f"^.*:({_V4})$", 1)
    full = F.when(tail != "", F.concat(F.regexp_extract(base, f"^(.*:){_V4}$", 1), _hextets(tail))).otherwise(base)
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def filled(halves: Column) -> Column:
        left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        fits = ((F.size(halves) == 1) & (missing == 0)) | ((F.size(halves) == 2) & (missing > 0))
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def written(all_groups: Column) -> Column:
        valid = F.forall(all_groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, _let(F.array_join(F.transform(all_groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"), short))

    def short(joined: Column) -> Column:
        parts = F.split(joined, ":")
        number = lambda i: F.conv(parts[i], 16, 10).cast("int")
        mapped = F.concat_ws(".", *[x.cast("string") for i in (6, 7) for x in (F.floor(number(i) / 256), number(i) % 256)])
        edged = F.concat(F.lit(":"), joined, F.lit(":"))
        out = F.concat(joined, scope)
        for n in range(2, 9):  # the longest run of zeros decides, the first of equal ones
            run = ":0" * n + ":"
            before = F.substring_index(edged, run, 1)
            after = F.substring(edged, F.char_length(before) + len(run) + 1, F.char_length(edged))
            tight = F.concat(F.ltrim(before, F.lit(":")), F.lit("::"), F.rtrim(after, F.lit(":")), scope)
            out = F.when(F.contains(edged, F.lit(run)), tight).otherwise(out)
        return F.when(joined.startswith("0:0:0:0:0:ffff:"), mapped).otherwise(out)

    return F.when(~F.contains(text, F.lit("%")) | (scope != ""), _let(F.split(full, "::", -1), lambda h: _let(filled(h), written)))


def is_ip(text: Column) -> Column:
    """Whether a text is an IPv4 or IPv6 address; null for null."""
    return F.when(F.contains(text, F.lit(":")), _ipv6(text).isNotNull()).otherwise(text.rlike(f"^{_V4}$"))


def iso_date(text: Column) -> Column:
    """A date written in full (YYYY-MM-DD); null for any other text."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text))


def host_aliases(name: Column) -> Column:
    """The lower-cased name without a final dot, and its first label; none for null or empty names."""
    n = F.lower(F.rtrim(F.trim(name), F.lit(".")))
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(n, F.split_part(n, F.lit("."), F.lit(1)))))


def norm_identity(user: Column, domain: Column) -> Column:
    """``domain\\user``, unless the user is empty or already qualified, or there is no domain."""
    qualified = user.contains("\\") | user.contains("@")
    return F.when(F.coalesce(user, F.lit("")) == "", user).when(qualified | (F.coalesce(domain, F.lit("")) == ""), user).otherwise(F.concat(domain, F.lit("\\"), user))


def host_equivalent(observed: Column, observed_mapped: Column, target_host: Column, target_ip: Column, target_mapped: Column) -> Column:
    """Whether a named host is the target: the same IP, or a common alias once either side's IP is mapped to its host."""
    seen = F.array_union(host_aliases(F.trim(observed)), host_aliases(observed_mapped))
    target = F.array_union(host_aliases(target_host), host_aliases(target_mapped))
    return F.when(F.coalesce(observed, F.lit("")) == "", F.lit(False)).otherwise(F.coalesce(F.trim(observed) == target_ip, F.lit(False)) | F.arrays_overlap(seen, target))


def host_keys(name: Column, mapped: Column, ip: Column) -> Column:
    """What a host goes by: the aliases of its name and of its mapped name, and its IP.  Two sides are equivalent (see :func:`host_equivalent`) if they share one of them."""
    aliases = F.transform(F.array_union(host_aliases(name), host_aliases(mapped)), lambda a: F.concat(F.lit("name "), a))
    return F.array_compact(F.array_append(aliases, F.concat(F.lit("ip "), ip)))


def event_code(variant: Column) -> Column:
    """``event.code`` as text whether it was a number or text; ``winlog.event_id`` where it is missing."""
    return F.coalesce(F.try_variant_get(variant, "$.event.code", "string"), F.try_variant_get(variant, "$.winlog.event_id", "string"))


def strings_at(variant: Column, path: str) -> Column:
    """A field that may be one text or an array of texts, as an array; empty where it is missing."""
    one = F.try_variant_get(variant, path, "string")
    many = F.try_variant_get(variant, path, "array<string>")
    return F.coalesce(many, F.when(one.isNotNull() & (one != ""), F.array(one)), F.array().cast("array<string>"))


def categories(variant: Column) -> Column:
    return strings_at(variant, "$.event.category")


def is_network(cats: Column) -> Column:
    """Membership among the categories, at any position."""
    return F.array_contains(cats, "network")


def host_ips(variant: Column) -> Column:
    return F.array_distinct(F.array_compact(strings_at(variant, "$.host.ip")))


def service_of_port(port: Column) -> Column:
    return _lookup(port.cast("int"), SERVICE_BY_PORT)


def service_of_logon_type(logon_type: Column) -> Column:
    return _lookup(logon_type.cast("string"), SERVICE_BY_LOGON_TYPE)


def service_of(port: Column, logon_type: Column) -> Column:
    """rdp or smb where port and logon type name the same service, else null."""
    return F.when(service_of_port(port) == service_of_logon_type(logon_type), service_of_port(port))


def protocol_of(port: Column) -> Column:
    return _lookup(port.cast("int"), PROTOCOL_BY_PORT)


def edge_id(host: Column, user: Column, logon_id: Column, ts_raw: Column, src_ip: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by ``|``; a missing part is the word None."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (host, user, logon_id, ts_raw, src_ip)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def canonical_hash(raw_json: Column) -> Column:
    """SHA-256 of the record with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.parse_json(raw_json)), 256)


def evidence_ref(event_id: Column, raw_json: Column) -> Column:
    """The event's id, or ``raw-`` and 16 hex digits that depend on its content alone; never null (no content is JSON's null, text that isn't JSON counts as it is)."""
    content = F.coalesce(raw_json, F.lit("null"))
    digest = F.sha2(F.coalesce(F.to_json(F.try_parse_json(content)), content), 256)
    return F.when(F.coalesce(event_id, F.lit("")) != "", event_id).otherwise(F.concat(F.lit("raw-"), F.substring(digest, 1, 16)))


def entity(kind: str, prefix: str, identifier: Column, display: Column | None = None) -> Column:
    """(kind, id, display_name) with a namespaced id."""
    name = F.lit(None).cast("string") if display is None else F.nullif(display, F.lit(""))
    return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(prefix), identifier).alias("id"), name.alias("display_name"))


def on_prem_identity(value: Column) -> Column:
    return F.when(value.isNotNull(), entity("identity", "identity:on_prem:", value, value))


def on_prem_host(value: Column) -> Column:
    return F.when(value.isNotNull(), entity("host", "host:on_prem:", value, value))


def aws_actor(arn: Column, principal: Column, user_name: Column) -> tuple[Column, Column]:
    """(id, display name) of a caller: arn, else principal id; user name, else the id."""
    blank = F.lit("")
    actor = F.coalesce(F.nullif(arn, blank), F.nullif(principal, blank))
    return actor, F.coalesce(F.nullif(user_name, blank), actor)


def role_short_name(arn: Column) -> Column:
    return F.substring_index(arn, "/", -1)


def shift_timestamp(df: DataFrame, seconds: float, ts: str = "ts", raw: str = "ts_raw") -> DataFrame:
    """Correct a recorded clock offset in the timestamp and in its text."""
    moved = df.withColumn(ts, F.col(ts) + F.make_dt_interval(secs=F.lit(float(seconds))))
    return moved.withColumn(raw, iso_text(F.col(ts))) if raw in df.columns else moved


def iso_text(ts: Column) -> Column:
    """UTC ISO-8601 with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))
