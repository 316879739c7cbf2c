"""Text functions as column expressions, with plain-Python twins where a driver needs them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Fold A-Z only; other letters keep their case."""
    return F.translate(x, UPPER, LOWER)


def prefix(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def is_cut(text: Column, n: int) -> Column:
    """Whether :func:`prefix` leaves something out."""
    return F.length(text) > n


def excerpt(text: Column, n: int) -> Column:
    """The first ``n`` characters on one line."""
    return F.translate(prefix(text, n), "\n\r\t", "   ")


def trim_excerpt(text: Column) -> Column:
    """Without control characters and spaces at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalize_key(x: Column, most: int) -> Column:
    """Lower-case ASCII letters and digits with single dashes between, at most ``most`` characters."""
    dashed = F.regexp_replace(ascii_lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-", ""), 1, most), "-+$", "")


def normalize_key_py(x: str | None, most: int) -> str:
    dashed = re.sub("[^a-z0-9]+", "-", (x or "").translate(str.maketrans(UPPER, LOWER)))
    return dashed.removeprefix("-")[:most].rstrip("-")


#: Characters kept of each normalised note field.
KEY_SIZES = {"type": 31, "place": 63, "who": 63, "state": 15}

TIME = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"


def artifact_time(text: Column, mtime: Column) -> Column:
    """The first ISO time on the first line, else ``mtime`` (seconds, 0: unknown) in UTC, else ''."""
    found = F.regexp_extract(F.substring_index(text, "\n", 1), TIME, 0)
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(mtime), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(found != "", found).when(mtime > 0, stamp).otherwise(F.lit(""))


def first_time_py(text: str) -> str:
    m = re.search(TIME, text.split("\n", 1)[0], re.A)
    return m[0] if m else ""


def url_path(x: Column) -> Column:
    """Percent-encoded but for letters, digits and ``-_.~/``."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _rest(path: Column, ns: str) -> Column:
    return F.substr(path, F.lit(len(ns) + 2))


def link_for(base: Column | str, path: Column) -> Column:
    """The web address of a source; null where there is none to tell."""
    base = F.lit(base) if isinstance(base, str) else base
    is_ = lambda ns: F.startswith(path, F.lit(f"{ns}:"))
    at = lambda page, x: F.concat(base, F.lit(page), x)
    file = F.when(F.startswith(path, F.lit("./")), F.substr(path, F.lit(3))).otherwise(path)
    out = F.when((F.coalesce(base, F.lit("")) == "") | (F.coalesce(path, F.lit("")) == ""), F.lit(None).cast("string"))
    out = out.when(is_("wiki"), at("/wiki?name=", url_path(_rest(path, "wiki"))))
    out = out.when(is_("ticket"), at("/tktview/", _rest(path, "ticket")))
    out = out.when(is_("forum"), at("/forumpost/", _rest(path, "forum")))
    for ns in ("ckin", "note", "tchg"):
        out = out.when(is_(ns), at("/info/", _rest(path, ns)))
    out = out.when(is_("attach"), at("/artifact/", _rest(path, "attach")))
    out = out.when(is_("uv"), at("/uv/", url_path(_rest(path, "uv"))))
    return out.when(F.contains(file, F.lit(":")), F.lit(None).cast("string")).otherwise(F.concat(base, F.lit("/file?name="), url_path(file), F.lit("&ci=tip")))


def link_label(path: Column) -> Column:
    """A short name for a source: ids are cut to 12 characters."""
    out = F.when(F.coalesce(path, F.lit("")) == "", F.lit("(unknown)"))
    out = out.when(F.startswith(path, F.lit("wiki:")), _rest(path, "wiki"))
    for ns in ("ticket", "forum", "ckin", "note", "tchg", "attach"):
        out = out.when(F.startswith(path, F.lit(f"{ns}:")), F.concat(F.lit(f"{ns} "), F.substring(_rest(path, ns), 1, 12)))
    return out.when(F.startswith(path, F.lit("uv:")), F.concat(F.lit("uv "), _rest(path, "uv"))).otherwise(path)


def duration_seconds(x: Column) -> Column:
    """Seconds of ``30``, ``30s``, ``5m``, ``2h`` or ``3d``; 0 for anything else."""
    n = F.regexp_extract(x, r"^[\t-\r\x20]*\+?(\d{1,15})(?:[smhd].*)?$", 1)
    unit = F.regexp_extract(x, r"^[\t-\r\x20]*\+?\d+([smhd]?)", 1)
    size = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(F.coalesce(n, F.lit("")) == "", F.lit(0).cast("long")).otherwise(n.try_cast("long") * size)


def duration_py(x: str | None) -> int:
    m = re.match(r"[\t-\r ]*\+?(\d{1,15})(?:([smhd]).*)?\Z", x or "", re.A | re.S)
    return int(m[1]) * {"m": 60, "h": 3600, "d": 86400}.get(m[2], 1) if m else 0


def iso_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def iso_plus(now: str, seconds: int) -> str:
    """``now`` moved by ``seconds``; always with microseconds, so that text order is time order."""
    form = "%Y-%m-%dT%H:%M:%S.%fZ" if "." in now else "%Y-%m-%dT%H:%M:%SZ"
    return (datetime.strptime(now, form) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


_ESCAPES = {"s": " ", "t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v", "0": "\0"}


def unquote_py(x: str | None) -> str | None:
    """Undo backslash escapes from left to right; an unknown one stands for its character."""
    return x if x is None else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), x, flags=re.S)


def unquote(x: Column) -> Column:
    """:func:`unquote_py` over pieces: every second part after a split at the escapes is one."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    one = lambda p: F.when(
        F.startswith(p, F.lit("\\")) & (F.length(p) == 2),
        F.coalesce(F.create_map(*[F.lit(v) for k, e in _ESCAPES.items() for v in (k, e)])[F.substring(p, 2, 1)], F.substring(p, 2, 1)),
    ).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def header(kind: str, **parts: Column) -> Column:
    """The frozen header line of a source class."""
    p, cut = parts, lambda c: F.substring(c, 1, 16)
    if kind == "ckin":
        return F.concat(F.lit("check-in "), cut(p["uuid"]), F.lit(" on "), p["ts"], F.lit(" by "), one_line(p["user"]), F.lit(" branch "), one_line(p["branch"]))
    if kind == "note":
        return F.concat(F.lit("tech note "), cut(p["uuid"]), F.lit(" on "), p["ts"], F.lit(" by "), one_line(p["user"]))
    if kind == "tchg":
        return F.concat(F.lit("ticket "), cut(p["uuid"]), F.lit(" changed "), p["ts"], F.lit(" by "), one_line(p["user"]))
    if kind == "attach":
        return F.concat(F.lit("attachment "), one_line(p["file"]), F.lit(" on "), one_line(p["target"]), F.lit(" at "), p["ts"])
    if kind == "uv":
        return F.concat(F.lit("unversioned file "), one_line(p["name"]))
    raise ValueError(f"no header for {kind}")


def one_line(x: Column) -> Column:
    return F.translate(F.coalesce(x, F.lit("-")), "\r\n", "  ")


def compose(*parts: Column) -> Column:
    """Parts with blank lines between."""
    return F.concat_ws("\n\n", *parts)


def julian_iso(x: Column) -> Column:
    """A Julian day number as ISO time to the second, UTC."""
    seconds = F.round((x - F.lit(2440587.5)) * 86400.0, 3)
    stamp = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


# POSIX extended regular expressions

_CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "blank": r"\p{Blank}", "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}"}


class BadPattern(ValueError):
    """A pattern that POSIX extended syntax does not have."""


def ere(pattern: str, ignore_case: bool = False) -> str:
    """A Java pattern that finds what a newline-aware POSIX extended one finds.

    ``^`` and ``$`` hold at lines; neither ``.`` nor a negated set crosses a
    line.  Java's own escapes, look-around, lazy and possessive quantifiers are
    refused rather than understood as something else.
    """
    out, i, n, depth, last = ["(?di)" if ignore_case else "(?d)"], 0, len(pattern), 0, False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                raise BadPattern("trailing backslash")
            if pattern[i + 1].isalnum():
                raise BadPattern(f"unknown escape \\{pattern[i + 1]}")
            out.append("\\" + pattern[i + 1])
            i, last = i + 2, True
        elif c == "[":
            text, i = _bracket(pattern, i)
            out.append(text)
            last = True
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?":
                raise BadPattern("(? is not POSIX")
            depth, last = depth + 1, False
            out.append("(")
            i += 1
        elif c == ")":
            if not depth:
                raise BadPattern("unmatched )")
            depth, last = depth - 1, True
            out.append(")")
            i += 1
        elif c in "*+?":
            if not last:
                raise BadPattern(f"{c} repeats nothing")
            if pattern[i + 1 : i + 2] and pattern[i + 1] in "*+?":
                raise BadPattern("two repetitions in a row")
            out.append(c)
            i += 1
        elif c == "{":
            m = re.match(r"\{\d+(,\d*)?\}", pattern[i:])
            if not m or not last:
                raise BadPattern("malformed {}")
            if pattern[i + len(m[0]) : i + len(m[0]) + 1] in tuple("*+?"):
                raise BadPattern("two repetitions in a row")
            out.append(m[0])
            i += len(m[0])
        else:
            # Java's own line anchors know more line ends and miss an empty last line.
            out.append({"^": "(?<![^\\n])", "$": "(?![^\\n])", ".": ".", "|": "|"}.get(c) or (c if c.isalnum() else re.escape(c)))
            last = c not in "|^$"
            i += 1
    if depth:
        raise BadPattern("unmatched (")
    return "".join(out)


def _bracket(p: str, i: int) -> tuple[str, int]:
    j = i + 1
    negated = p[j : j + 1] == "^"
    j += negated
    out, first = [], True
    while True:
        if j >= len(p):
            raise BadPattern("unmatched [")
        if p[j] == "]" and not first:
            break
        first = False
        if p.startswith("[:", j):
            end = p.find(":]", j)
            name = p[j + 2 : end] if end > 0 else ""
            if name not in _CLASSES:
                raise BadPattern(f"unknown class [:{name}:]")
            out.append(_CLASSES[name])
            j = end + 2
            continue
        if p[j + 1 : j + 2] == "-" and p[j + 2 : j + 3] not in ("", "]"):
            a, b = p[j], p[j + 2]
            if a > b:
                raise BadPattern("range out of order")
            out.append(f"{_member(a)}-{_member(b)}")
            j += 3
            continue
        out.append(_member(p[j]))
        j += 1
    body = "".join(out)
    return (f"[^{body}\\n]" if negated else f"[{body}]"), j + 1


def _member(c: str) -> str:
    return c if c.isalnum() else "\\" + c if c in r"\[]^-&~" else c
