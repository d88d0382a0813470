"""Web presence: candidate domains from names and e-mails, and what a stored page says."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.cleaning import channel_value, deaccent
from regspark.sources.scratch import once, stored

#: Endings tried, and how many candidates are kept.
ENDINGS, MAX_CANDIDATES = ("com.ec", "ec"), 8
#: Free e-mail providers give no domain of the company's own.
FREE_MAIL = "gmail.com googlemail.com hotmail.com hotmail.es outlook.com outlook.es live.com msn.com yahoo.com yahoo.es ymail.com icloud.com me.com aol.com protonmail.com proton.me zoho.com gmx.com mail.com andinanet.net yahoo.com.mx hotmail.com.ar".split()
#: Words that are no candidate by themselves, as their domains are somebody else's.
GENERIC_WORDS = (
    "comercial comercializadora servicios servicio importadora exportadora distribuidora constructora construcciones inmobiliaria consultora consultores asesores asociados hermanos grupo "
    "corporacion corporativo empresa negocios inversiones proyectos soluciones sistemas tecnologia industrias industrial productos agricola ganadera transportes transporte turismo ecuador "
    "internacional nacional global general centro casa hotel restaurante farmacia ferreteria clinica laboratorio estudio"
).split()
#: Legal forms and joining words say nothing about a company.
LEGAL_WORDS = "CIA COMPANIA COMPANIALTDA LTDA LIMITADA SA SAS CA SOCIEDAD ANONIMA CIVIL MERCANTIL DEL DE LA LAS EL LOS Y E AND THE S A C L".split()
#: Hosts of social networks, and for each network the paths that are no profile.
NETWORKS = {
    "facebook.com": "facebook", "fb.com": "facebook", "fb.me": "facebook", "web.facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "tiktok.com": "tiktok", "twitter.com": "x", "x.com": "x",
    "youtube.com": "youtube", "youtu.be": "youtube", "wa.me": "whatsapp", "api.whatsapp.com": "whatsapp", "web.whatsapp.com": "whatsapp", "chat.whatsapp.com": "whatsapp", "t.me": "telegram", "telegram.me": "telegram",
}
NO_PROFILE = {
    "facebook": "sharer share dialog plugins tr login help policies privacy", "instagram": "p reel explore accounts share", "linkedin": "shareArticle sharing share feed login legal", "tiktok": "share embed login legal",
    "x": "intent share home search hashtag i privacy tos", "youtube": "watch embed results feed playlist shorts", "telegram": "share joinchat",
}
#: What parked and unfinished pages say, without accents.
PARKED = [
    "this domain is for sale", "domain is for sale", "dominio en venta", "buy this domain", "comprar este dominio", "parked free, courtesy of", "sedoparking", "domain parking", "godaddy.com/domainsearch",
    "the domain you are looking for", "sitio en construccion", "under construction", "default web page", "apache2 ubuntu default page", "welcome to nginx", "index of /",
]


def name_words(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.upper(deaccent(name)), "[^A-Z0-9]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(LEGAL_WORDS))


def domain_candidates(rows: DataFrame, key: str, name: str, email: str) -> DataFrame:
    """key, rank (from 1), domain, origin: the own e-mail domain first, then labels from the
    name (all words, the first two, each of five letters or more) under each ending."""
    w = name_words(F.col(name))
    labels = F.array_distinct(F.concat(F.array(F.array_join(w, ""), F.array_join(F.slice(w, 1, 2), "")), F.filter(w, lambda x: (F.length(x) >= 5) & ~F.lower(x).isin(GENERIC_WORDS))))
    labels = F.filter(F.transform(labels, F.lower), lambda x: F.length(x).between(4, 30))
    from_name = F.flatten(F.transform(labels, lambda x: F.array(*(F.concat(x, F.lit(f".{e}")) for e in ENDINGS))))
    host = F.lower(F.trim(F.substring_index(F.col(email), "@", -1)))
    own = F.when(F.col(email).contains("@") & ~host.isin(FREE_MAIL), F.array(host)).otherwise(F.array().cast("array<string>"))
    listed = rows.select(key, own.alias("_own"), F.slice(F.array_distinct(F.concat(own, from_name)), 1, MAX_CANDIDATES).alias("_all"))
    out = listed.select(key, "_own", F.posexplode("_all").alias("pos", "domain"))
    return out.select(key, (F.col("pos") + 1).alias("rank"), "domain", F.when(F.array_contains("_own", F.col("domain")), "email").otherwise("name").alias("origin"))


#: Characters that a description may have; a longer one is none.
DESCRIPTION = 500


def _meta(tags: Column, attribute: str, name: str) -> Column:
    """The content of the first meta tag whose attribute has this name, in either kind of quotes; null where there is none."""
    contents = F.transform(tags, lambda tag: F.regexp_extract_all(tag, F.lit(rf"""(?i)\b{attribute}=["']{name}["'].*?\bcontent=["']([^"']{{0,{DESCRIPTION}}})["']"""), F.lit(1)))
    return F.get(F.flatten(contents), F.lit(0))


def page_reading(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, description, text_length, parked: what a page says about itself.

    The description is og:description where a page has one, else its description; of several the first.
    """
    h = F.col(html)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))
    title = F.trim(F.regexp_replace(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    tags = F.regexp_extract_all(h, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    meta = F.coalesce(_meta(tags, "property", "og:description"), _meta(tags, "name", "description"))
    plain = F.lower(deaccent(text))
    parked = F.lit(False)
    for phrase in PARKED:
        parked = parked | plain.contains(phrase)
    return pages.select(key, F.nullif(title, F.lit("")).alias("title"), F.nullif(F.trim(F.regexp_replace(meta, r"\s+", " ")), F.lit("")).alias("description"), F.length(text).alias("text_length"), parked.alias("parked"))


def social_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, network, handle of the profiles that a page links to; share buttons and network home pages are left out."""
    links = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="(https?://[^"]+)"'), F.lit(1))).alias("url"))
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^(www|m|es-la)\.", "")
    path = F.try_parse_url("url", F.lit("PATH"))
    network = F.element_at(F.create_map(*(F.lit(x) for kv in NETWORKS.items() for x in kv)), host)
    other = F.lit(False)
    for name, paths in NO_PROFILE.items():
        other = other | ((F.col("network") == name) & F.col("path").rlike(rf"(?i)^/({paths.replace(' ', '|')})\b"))
    found = links.select(key, network.alias("network"), path.alias("path")).withColumn("handle", F.regexp_replace("path", "^/(company/|in/|school/|channel/|c/|user/|@)?/?|/+$", ""))
    return found.where(F.col("network").isNotNull() & ~other & (F.col("handle") != "")).select(key, "network", "handle").distinct()


def mentions(text: Column, name: Column) -> Column:
    """Whether all distinctive words of the name occur in the text."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.upper(deaccent(text)), "[^A-Z0-9]+", " "), F.lit(" "))
    w = F.filter(name_words(name), lambda x: F.length(x) >= 4)
    return (F.size(w) > 0) & F.forall(w, lambda x: plain.contains(F.concat(F.lit(" "), x, F.lit(" "))))


def _plain_words(text: Column) -> Column:
    """The words of a text that may be distinctive of a name: four letters or more."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(deaccent(text)), "[^A-Z0-9]+", " "), " "), lambda w: F.length(w) >= 4))


def visible_text(html: Column) -> Column:
    """A page's text without tags, scripts and styles."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), r"^www\.", "")


def distinctive_words(name: Column) -> Column:
    """The words of a name that tell its owner apart: four letters or more, no legal form, no generic word."""
    return F.array_sort(F.array_distinct(F.filter(name_words(name), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(GENERIC_WORDS))))


def name_mentions(owners: DataFrame, page_words: DataFrame, key: str = "owner", page: str = "page") -> DataFrame:
    """(name_key, page): pages that hold every distinctive word of a name, from (`key`, words) and (`page`, word).

    An inverted index on one word a name: names with equal words are one, and each meets only the
    pages that hold its rarest word; the other words are then looked up page by page, the next
    rarest first, so that each join only narrows what is left. All joins are on equality.
    """
    names = owners.where(F.size("words") > 0).select(F.col("words").alias("name_key")).distinct()
    frequency = page_words.groupBy("word").agg(F.count("*").alias("pages"))
    ranked = names.select("name_key", F.explode("name_key").alias("word")).join(frequency, "word", "left").groupBy("name_key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "word"))).alias("by_rarity"))
    open_ = ranked.where(F.col("by_rarity")[0]["pages"] > 0).select("name_key", F.transform("by_rarity", lambda x: x["word"]).alias("w"))
    found = open_.withColumn("word", F.col("w")[0]).join(page_words, "word").select("name_key", "w", page)
    second = found.where(F.size("w") > 1).withColumn("word", F.get("w", F.lit(1))).join(page_words, ["word", page], "left_semi").select("name_key", "w", page)
    many = second.where(F.size("w") > 2).select("name_key", page, F.size("w").alias("n"), F.explode(F.slice("w", 3, 1000)).alias("word"))
    all_ = many.join(page_words, ["word", page], "left_semi").groupBy("name_key", page, "n").agg(F.count("*").alias("hits")).where("hits = n - 2").select("name_key", page)
    return found.where(F.size("w") == 1).select("name_key", page).unionByName(second.where(F.size("w") == 2).select("name_key", page)).unionByName(all_)


def proposals(pages: DataFrame, owners: DataFrame, key: list[str], page: str = "page_id", url: str = "url", html: str = "html", name: str = "name", email: str = "email") -> DataFrame:
    """For each owner the page that is proposed as its own: `key`, page, rule (email or mention), site, words.

    The first page (by number) on the host of the owner's e-mail address is proposed without further
    proof, unless the address is at a free provider; else the first page that mentions every
    distinctive word of the name. Parked pages are passed over; an owner without either has no row.
    Null names, addresses, URLs and pages give nothing.
    """
    plain = pages.where(F.col(page).isNotNull()).select(F.col(page).alias("page"), host_of(F.col(url)).alias("host"), once(F.lower(deaccent(visible_text(F.coalesce(F.col(html), F.lit("")))))).alias("plain"))
    unparked = plain.where(~F.col("plain").rlike("|".join(map(re.escape, PARKED))))
    read = stored(unparked.select("page", "host", _plain_words(F.col("plain")).alias("words")), "pages")
    address = F.lower(F.trim(F.substring_index(F.col(email), "@", -1)))
    listed = owners.select(*key, distinctive_words(F.coalesce(F.col(name), F.lit(""))).alias("words"), F.when(F.col(email).contains("@") & ~address.isin(FREE_MAIL), address).alias("domain"))
    by_host = read.where("host <> ''").groupBy(F.col("host").alias("domain")).agg(F.min("page").alias("own_page"))
    wanted = listed.select(F.explode("words").alias("word")).distinct()
    words = stored(read.select("page", F.explode("words").alias("word")).join(wanted, "word", "left_semi").select("page", "word"), "page-words")
    mentioned = name_mentions(listed, words).groupBy(F.col("name_key").alias("words")).agg(F.min("page").alias("named_page"))
    both = listed.join(by_host, "domain", "left").join(mentioned, "words", "left").where("own_page IS NOT NULL OR named_page IS NOT NULL")
    chosen = both.select(*key, F.coalesce("own_page", "named_page").alias("page"), F.when(F.col("own_page").isNotNull(), "email").otherwise("mention").alias("rule"), F.array_join("words", " ").alias("words"))
    sites = pages.select(F.col(page).alias("page"), channel_value(F.lit("site"), F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)).alias("site")).where("page IS NOT NULL").groupBy("page").agg(F.min("site").alias("site"))
    return chosen.join(sites, "page").select(*key, F.col("page").alias(page), "rule", "site", "words")
