"""Text functions as column expressions: folding, names, hosts, e-mail, phones, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the letters they fold to (fixed values).
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Legal forms that are no part of a name (fixed values).
LEGAL_FORMS = ["ag", "bv", "co", "corp", "gmbh", "inc", "llc", "ltd", "sa", "sarl", "spa", "srl"]
#: Hosts of mail boxes that anyone can have (fixed values).
FREEMAIL = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.fr", "yahoo.de", "hotmail.com", "hotmail.co.uk", "hotmail.fr", "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com",
    "gmx.de", "gmx.net", "gmx.at", "web.de", "t-online.de", "freenet.de", "orange.fr", "wanadoo.fr", "free.fr", "laposte.net", "libero.it", "virgilio.it", "naver.com", "daum.net", "qq.com", "163.com", "126.com",
    "yandex.ru", "mail.ru", "protonmail.com", "proton.me", "zoho.com", "bigpond.com", "seznam.cz", "wp.pl",
]
#: Words that a local part of a role begins with, by rank: 0 are the most useful (fixed values).
ROLE_RANKS = {
    0: "purchasing purchase procurement buying buyer sourcing einkauf achat compras acquisti inkoop import",
    1: "trade trading commercial export",
    2: "info contact kontakt office mail hello hallo general enquiries inquiries enquiry inquiry",
    3: "service sales vertrieb verkauf ventas vendite order bestellung customerservice",
    4: "admin support",
}
#: Ranks of local parts that name no role (fixed values).
OTHER_RANK, PERSON_RANK = 5, 6
#: Beginnings of local parts that are never a contact, and marks of addresses that soon end (fixed values).
NEVER = r"^(no-?reply|do-?not-?reply|bounce|mailer-daemon|postmaster|abuse|webmaster|privacy|datenschutz|gdpr|dpo|jobs|careers|karriere|bewerbung|hr|press|presse|newsletter)\b"
DISPOSABLE = r"(mailinator|tempmail|10minutemail|guerrillamail|trashmail)"
#: Hosts and endings of what looks like an address on a page and is none (fixed values).
NO_ADDRESS = r"@(sentry|example\.|localhost|test\.|domain\.|sample\.|placeholder\.|wixpress\.com|jsdelivr|cloudflare|googletagmanager|hotjar|intercom|sentry-next)"
NO_ADDRESS_END = r"\.(png|jpe?g|gif|svg|webp|css|js|ico)$"
#: Local parts that are never a contact, in free text (fixed values).
BLOCKED_LOCALS = ["noreply", "no-reply", "privacy", "abuse", "postmaster"]
#: Second-level labels under which names are registered (fixed values).
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "or", "ne"]
#: Numbers after a word that announces them, and international ones (fixed values).
LABELLED_PHONE = r"(?i)(?:tel(?:efon|ephone|éfono|efone)?|phone|fon|t\.|ph\.|call|電話|电话|전화)\s*[:.]?\s*(\+?[0-9][0-9\s().\-/]{6,20}[0-9])"
WORLD_PHONE = r"((?:\+|00)[0-9][0-9\s().-]{7,17}[0-9])"
#: Words of links that lead to contacts (fixed values).
CONTACT_LINK = r"(?i)(contact|kontakt|contacto|contatti|impressum|about|over-ons|uber-uns|ueber-uns|qui-sommes|nous-contacter|company|unternehmen|empresa|azienda|team|imprint|会社|お問い合わせ|联系|关于|회사|문의)"
#: Labels of a link to the next page, and addresses of numbered pages (fixed values).
NEXT_LABEL = r"(?i)^(next|next page|›|»|>|weiter|nächste|suivant|suivante|volgende|siguiente|successiva|próxima|次へ|下一页|다음)$"
PAGE_NUMBER = r"(?i)([?&](page|p|pg|seite|pagina|start|offset)=[0-9]+)|(/page/[0-9]+)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()./-]{6,20}[0-9]"


def norm(text: Column) -> Column:
    """Lower case, no marks on letters, only letters and digits with single spaces, a space at both ends."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " ")), F.lit(" "))


#: Letters whose capitals Java writes with two letters though there is one, and those (fixed values).
SMALL, CAPITAL = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def capitals(text: Column) -> Column:
    """The text in capitals, letter by letter, so that it keeps its length: a letter without a capital of its own stays."""

    def one(letter: Column) -> Column:
        known = F.translate(letter, SMALL, CAPITAL)
        return F.when((known == letter) & (F.length(F.upper(letter)) == 1), F.upper(letter)).otherwise(known)

    return F.when(text.rlike(r"^\p{ASCII}*$"), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def words(text: Column, least: int = 1) -> Column:
    """The words of a normalised text that have at least so many letters."""
    return F.filter(F.split(F.trim(norm(text)), " "), lambda w: F.length(w) >= least)


def host(url: Column) -> Column:
    """The host of a URL without `www.`; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def registrable(name: Column) -> Column:
    """The part of a host that is registered: two labels, or three under a second-level label."""
    parts = F.split(name, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".")
    three = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), 3), ".")
    deep = (F.size(parts) >= 3) & F.element_at(parts, -2).isin(SECOND_LEVEL) & (F.length(F.element_at(parts, -1)) == 2)
    return F.when(F.size(parts) < 2, name).when(deep, three).otherwise(two)


def website(url: Column, social: tuple[str, ...] = ("facebook.com", "linkedin.com", "instagram.com")) -> Column:
    """`https://` and the host; null for social networks and what is no host."""
    name = F.regexp_extract(F.lower(F.trim(url)), r"^(?:https?://)?([^/?#:]+)", 1)
    bad = ~name.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$") | F.regexp_replace(name, r"^www\.", "").isin(*social)
    return F.when(~bad, F.concat(F.lit("https://"), name))


def email_kind(email: Column) -> Column:
    """(kind, rank) of an address: role, personal or other; the lower the rank, the better."""
    local = F.substring_index(F.lower(F.trim(email)), "@", 1)
    role = F.coalesce(*[F.when(local.rlike(f"^(?:{'|'.join(words.split())})"), rank) for rank, words in ROLE_RANKS.items()])
    personal = local.rlike(r"^[a-z]{2,}[._-][a-z]{2,}$") | local.rlike(r"^[a-z]\.?[a-z]{3,}$")
    kind = F.when(role.isNotNull(), "role").when(personal, "personal").otherwise("other")
    return F.struct(kind.alias("kind"), F.coalesce(role, F.when(personal, PERSON_RANK).otherwise(OTHER_RANK)).alias("rank"))


def email_status(email: Column) -> Column:
    """freemail, role, personal or domain; null for what is no address."""
    address = F.lower(F.trim(email))
    kind = email_kind(email)["kind"]
    return F.when(address.rlike(f"^{EMAIL}$"), F.when(F.substring_index(address, "@", -1).isin(FREEMAIL), "freemail").when(kind == "other", "domain").otherwise(kind))


def email_usable(email: Column) -> Column:
    """Whether an address may be a contact: well formed, read by someone, there to stay."""
    address = F.lower(F.trim(email))
    ok = address.rlike(f"^{EMAIL}$") & ~F.substring_index(address, "@", 1).rlike(NEVER) & ~address.rlike(DISPOSABLE)
    return F.coalesce(ok, F.lit(False))


def phone(number: Column) -> Column:
    """Digits with a leading plus if there is one (or two zeros); null unless 8 to 15 digits."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(number), r"[^0-9+]", ""), r"^00", "+")
    digits = F.regexp_replace(kept, r"\+", "")
    return F.when(F.length(digits).between(8, 15), F.concat(F.when(kept.startswith("+"), "+").otherwise(""), digits))


#: Ways to write the signs of an address out, with brackets and without (fixed values).
AT_SIGN = r"\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|\[@\]|\(@\)|&#64;)\s*"
DOT_SIGN = r"\s*(?:\[\s*(?:dot|punkt)\s*\]|\(\s*(?:dot|punkt)\s*\))\s*"
SPOKEN = r"[a-z0-9._%+-]+\s+at\s+[a-z0-9-]+(?:(?:\.|\s+dot\s+)[a-z0-9][a-z0-9-]*)+"

#: Signs are sought where a bracket, or a run of blanks before one, begins, so that each run of blanks is passed once.
_AT_ONCE, _DOT_ONCE = (rf"(?=[\s{first}])(?:\G|(?<!\s))\s*+(?=[{first}])" + sign.removeprefix(r"\s*") for first, sign in ((r"\[({&", AT_SIGN), (r"\[(", DOT_SIGN)))


def emails(text: Column) -> Column:
    """All distinct addresses of a text in lower case, sorted; written out ones (`name (at) host [dot] de`, `name at host dot de`) too."""
    return F.get(F.transform(F.array(_opened(text)), _addresses), F.lit(0))  # within a function of it, so that the text is opened once


def _opened(text: Column) -> Column:
    """A text in lower case with its written-out signs as signs."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), _AT_ONCE, "@"), _DOT_ONCE, ".")


def _addresses(opened: Column) -> Column:
    """The addresses of an opened text."""
    # each local part is tried once, where its letters begin or an address before it ends
    eager = EMAIL.replace("+@", "++@", 1)  # the local part has no @, so giving letters back finds nothing more
    found = F.regexp_extract_all(opened, F.lit(rf"(?:\G|(?<![A-Za-z0-9._%+-]))({eager})"), 1)
    # a spoken address begins where a word does, so each word is tried once
    spoken = F.regexp_extract_all(opened, F.lit(f"(?<![a-z0-9._%+-]){SPOKEN.replace("]+", "]++", 1)}"), 0)
    written = F.filter(F.transform(spoken, lambda e: F.regexp_replace(F.regexp_replace(e, r"\s+at\s+", "@"), r"\s+dot\s+", ".")), lambda e: e.rlike(f"^{EMAIL}$") & (F.length(F.substring_index(e, "@", 1)) <= 40))
    return F.array_sort(F.array_distinct(F.filter(F.concat(found, written), lambda e: ~F.substring_index(e, "@", 1).isin(BLOCKED_LOCALS))))


def phones(text: Column) -> Column:
    """All distinct numbers of 8 to 15 digits, as digits, sorted; what looks like a date is none."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1), lambda p: ~p.rlike(r"^(19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}"))
    digits = F.transform(found, lambda p: F.regexp_replace(p, r"[^0-9]", ""))
    return F.array_sort(F.array_distinct(F.filter(digits, lambda d: F.length(d).between(8, 15))))


def email_from_hex(code: Column) -> Column:
    """The address that a page hides as hex digits: the first byte is the key, the others are the characters xor it."""
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, 2), 16, 10).cast("int")
    chars = F.transform(F.sequence(F.lit(1), F.floor(F.length(code) / 2).cast("int") - 1), lambda i: F.chr(byte(i).bitwiseXOR(byte(F.lit(0)))))
    return F.when(code.rlike("^[0-9a-fA-F]{6,}$") & (F.length(code) % 2 == 0), F.array_join(chars, ""))


_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments and tags, entities decoded, white space squeezed."""
    bare = reduce(lambda c, p: F.regexp_replace(c, p, " "), [r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"], html)
    return F.trim(F.regexp_replace(_decoded(bare), r"[ \t\r\n\f]+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: The attributes of a tag up to one of a link's target, and the target, in either quotes or in none.
_BEFORE_HREF, _HREF = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?""", r"""(?<=[\s"'/])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""


def _decoded(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES.items(), text)


def _target(value: Column) -> Column:
    """A target without its quotes and the blanks around it, entities decoded."""
    return _decoded(F.trim(F.regexp_replace(value, r"""^["']|["']$""", "")))


def links(html: Column) -> Column:
    """The distinct targets of a page's links, whatever their quotes, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_BEFORE_HREF + _HREF), 1), _target)))


def scripts_of_data(html: Column) -> Column:
    """The texts of a page's structured data."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)


#: A JSON string, and one with the string that it names, if it names one.
_STRING = r'"((?:[^"\\]|\\.)*+)"'
_NAMED_STRING = rf"(?s){_STRING}(?:\s*:\s*{_STRING})?"


def _unescaped(raw: Column) -> Column:
    """What a JSON string says."""
    return F.when(F.contains(raw, F.lit("\\")), F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0))).otherwise(raw)


def data_values(html: Column, *names: str) -> Column:
    """All text values of these names in a page's structured data, at any depth, in order, escapes decoded.

    A script that is no JSON, or names a value twice in one object, has none. In one
    that is JSON every quotation mark belongs to a string, so its strings are cut out
    one after the other, each with the string that it names.
    """

    def of_script(script: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(script, F.lit(_NAMED_STRING), 1).alias("k"), F.regexp_extract_all(script, F.lit(_NAMED_STRING), 2).alias("v"))
        found = F.filter(pairs, lambda p: (p["v"] != "") & F.lower(_unescaped(p["k"])).isin(*names))
        return F.when(F.try_parse_json(script).isNotNull(), F.transform(found, lambda p: _unescaped(p["v"]))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(scripts_of_data(html), of_script))


def page_emails(html: Column) -> Column:
    """All distinct addresses of a page, sorted: of mail links, hidden as hex, in structured data, in the text."""
    linked = F.regexp_extract_all(html, F.lit(r"""(?i)(?<=[\s"'/])href\s*=\s*["']?mailto:([^"'?\s>]+)"""), 1)
    hidden = F.regexp_extract_all(html, F.lit(r"""(?i)(?:data-cfemail=["']|/cdn-cgi/l/email-protection#)([0-9a-f]+)"""), 1)
    named = F.transform(data_values(html, "email"), lambda e: F.regexp_replace(e, "mailto:", ""))
    found = F.concat(F.transform(linked, lambda e: F.try_url_decode(F.replace(e, F.lit("+"), F.lit("%2B")))), F.transform(hidden, email_from_hex), named, emails(html_text(html)))
    clean = F.transform(F.array_compact(found), lambda e: F.regexp_replace(F.lower(F.trim(e)), r"^[.,;:]+|[.,;:]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda e: e.rlike(f"^{EMAIL}$") & ~e.rlike(NO_ADDRESS) & ~e.rlike(NO_ADDRESS_END))))


def page_phones(html: Column) -> Column:
    """The digits of all distinct numbers of a page, sorted: of call links, in structured data, announced or international ones in the text."""
    linked = F.transform(F.filter(F.transform(F.regexp_extract_all(html, F.lit(_BEFORE_HREF + _HREF), 1), _target), lambda h: h.rlike("(?i)^tel:")), lambda h: F.substring(h, 5, 1 << 30))
    text = html_text(html)
    found = F.concat(linked, data_values(html, "telephone", "phone"), F.regexp_extract_all(text, F.lit(LABELLED_PHONE), 1), F.regexp_extract_all(text, F.lit(WORLD_PHONE), 1))
    digits = F.transform(found, lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.array_sort(F.array_distinct(F.filter(digits, lambda d: F.length(d).between(8, 15) & ~d.rlike("^(19|20)[0-9]{6,}$"))))


def meta_description(html: Column, longest: int = 400) -> Column:
    """What a page says of itself; null if nothing."""
    tag = F.regexp_extract(html, r"""(?is)(<meta\s[^>]*(?:name=["']description["']|property=["']og:description["'])[^>]*>)""", 1)
    content = F.regexp_extract(tag, r"""(?is)content=["']([^"']*)["']""", 1)
    return F.nullif(F.substring(F.trim(F.regexp_replace(content, r"\s+", " ")), 1, longest), F.lit(""))


def anchors(html: Column, url: Column) -> Column:
    """(href, label) of the links to the same host, hrefs made absolute and without their fragment, in order."""
    whole = F.regexp_extract_all(html, F.lit(rf"{_BEFORE_HREF}{_HREF}(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</a>"), 0)
    site, base = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract(url, r"^([a-z]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    base = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    scheme = F.regexp_extract(url, r"^([a-z]+:)", 1)

    def absolute(href: Column) -> Column:
        full = F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(base, href))
        return F.regexp_replace(full, "#.*$", "")

    label = lambda a: _decoded(F.trim(F.regexp_replace(F.regexp_replace(a, r"""(?s)<(?:[^>"']|"[^"]*"|'[^']*')*>""", " "), r"\s+", " ")))
    raw = F.transform(whole, lambda a: F.struct(_target(F.regexp_extract(a, _BEFORE_HREF + _HREF, 1)).alias("href"), label(a).alias("label")))
    kept = F.filter(raw, lambda x: ~x["href"].rlike("(?i)^(mailto:|tel:|javascript:|#)"))
    full = F.transform(kept, lambda x: F.struct(absolute(x["href"]).alias("href"), x["label"].alias("label")))
    return F.filter(full, lambda x: host(x["href"]).eqNullSafe(host(url)))


def contact_links(html: Column, url: Column) -> Column:
    """The distinct links of a page that lead to contacts, sorted."""
    found = F.filter(anchors(html, url), lambda x: x["href"].rlike(CONTACT_LINK) | x["label"].rlike(CONTACT_LINK))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x["href"])))


def paging_links(html: Column, url: Column) -> Column:
    """The distinct links of a page that go on with its list, sorted: labelled `next`, or numbered or lettered ones under the same path."""
    path = lambda u: F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    bare = lambda u: F.regexp_replace(path(u), "/$", "")
    folder = F.regexp_replace(path(url), "/[^/]*$", "")
    near = lambda x: (bare(x["href"]) == bare(url)) | path(x["href"]).startswith(folder)
    goes_on = lambda x: x["label"].rlike(NEXT_LABEL) | (near(x) & (x["href"].rlike(PAGE_NUMBER) | x["label"].rlike("^([0-9]{1,3}|[A-Z])$")))
    found = F.filter(anchors(html, url), lambda x: (x["href"] != url) & goes_on(x))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x["href"])))


def name_tokens(name: Column) -> Column:
    """Words of a company's name that identify it."""
    return F.filter(words(name, 3), lambda w: ~w.isin(LEGAL_FORMS))


def share_present(tokens: Column, page: Column) -> Column:
    """Hundredths of the tokens that occur in a normalised text, also inside words; null without tokens."""
    here = F.size(F.filter(tokens, lambda t: F.contains(page, t)))
    return F.when(F.size(tokens) > 0, F.floor(here * 100 / F.size(tokens)))


def name_on_page(name: Column, page: Column, percent: int = 60) -> Column:
    """Whether a page names a company: enough of its tokens, or the whole name if it has none."""
    return F.coalesce(share_present(name_tokens(name), page) >= percent, F.contains(page, F.trim(norm(name))))


def quote_on_page(quote: Column, page: Column, percent: int = 85) -> Column:
    """Whether a quote stands on a page: as it is, or most of its long words do."""
    q = F.trim(norm(quote))
    long_words = F.filter(F.split(q, " "), lambda w: F.length(w) >= 4)
    enough = (F.size(long_words) >= 3) & F.coalesce(share_present(long_words, page) >= percent, F.lit(False))
    return (F.length(q) >= 15) & (F.contains(page, q) | enough)


def mostly_upper(name: Column) -> Column:
    letters = F.regexp_replace(name, r"[^A-Za-z]", "")
    return F.length(F.regexp_replace(letters, r"[^A-Z]", "")) > F.length(letters) * 0.8


def tidy_name(name: Column) -> Column:
    """Names in capitals as titles; legal forms in their usual spelling, words without vowels as they are."""
    usual = F.create_map(*[F.lit(x) for pair in (("gmbh", "GmbH"), ("ltd", "Ltd"), ("llc", "LLC"), ("sarl", "SARL"), ("ag", "AG"), ("bv", "BV"), ("sa", "SA")) for x in pair])
    title = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "-")
    one = lambda w: F.coalesce(usual[F.lower(w)], F.when(~F.lower(w).rlike("[aeiouy]"), w).otherwise(title(w)))
    squeezed = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(mostly_upper(squeezed), F.array_join(F.transform(F.split(squeezed, " "), one), " ")).otherwise(squeezed)


def short_title(text: Column, longest: int) -> Column:
    """The text before `;`, cut at a word with an ellipsis if it is too long."""
    head = F.trim(F.split(text, ";")[0])
    return F.when(F.length(head) > longest, F.concat(F.regexp_replace(F.substring(head, 1, longest), r"\s+\S*$", ""), F.lit("…"))).otherwise(head)


def excerpt(text: Column, focus: str, width: int) -> Column:
    """`width` characters around the first place of a word, from the start if it has none."""
    at = F.instr(F.lower(text), focus.lower())
    return F.substr(text, F.greatest(F.lit(1), at - width // 2).cast("int"), F.lit(width))


def chunks(text: Column, size: int) -> Column:
    """Pieces of at most `size` characters that end at spaces; a longer word is a piece of its own size."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(\S.{{0,{size - 1}}}(?=\s|$)|\S{{{size}}})"), 1), F.trim), lambda c: F.length(c) > 0)


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with `{{name}}` filled in; unknown names and nulls are empty."""
    filled = reduce(lambda c, kv: F.replace(c, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))
    return F.regexp_replace(filled, r"\{\{[^}]*\}\}", "")
