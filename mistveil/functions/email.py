"""Which e-mail addresses are public contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ROLE_NAMES = ("support", "info", "contact", "sales", "help", "noreply", "no-reply", "admin", "care", "hr", "careers")
FREE_MAIL = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "proton.me", "protonmail.com", "icloud.com", "rediffmail.com")
PUBLIC_FROM = 4


def host_of(url: Column) -> Column:
    """Host of a URL, empty if there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _flag(hints: Column | None, name: str) -> Column:
    return F.lit(False) if hints is None else F.coalesce(hints[name], F.lit(False))


def public_score(email: Column, origin: Column, hints: Column | None = None, is_mailto: Column | None = None) -> Column:
    """+3 role name, +3 the page's own domain or one below it, -4 free mail, +2 a contact context, -3 users' content."""
    name = F.lower(F.regexp_extract(email, "^(.*)@[^@]*$", 1))
    domain = F.regexp_replace(F.lower(F.substring_index(email, "@", -1)), r"\.$", "")
    host = F.regexp_replace(host_of(origin), r"\.$", "")
    own = (host != "") & ((domain == host) | F.endswith(domain, F.concat(F.lit("."), host)))
    mailto = F.lit(False) if is_mailto is None else F.coalesce(is_mailto, F.lit(False))
    contact = _flag(hints, "in_contact_markup") | _flag(hints, "near_contact_heading") | (_flag(hints, "in_landmark") & mailto)
    worth = lambda test, points: F.when(test, points).otherwise(0)
    total = worth(name.isin(*ROLE_NAMES), 3) + worth(own, 3) + worth(domain.isin(*FREE_MAIL), -4) + worth(contact, 2) + worth(_flag(hints, "in_ugc_block"), -3)
    return F.when(F.instr(email, "@") == 0, 0).otherwise(total).cast("int")


def is_public(email: Column, origin: Column, hints: Column | None = None, is_mailto: Column | None = None) -> Column:
    return public_score(email, origin, hints, is_mailto) >= PUBLIC_FROM
