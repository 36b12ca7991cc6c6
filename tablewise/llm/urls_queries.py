"""Query of the URL filter."""

from tablewise.llm import urls
from tablewise.llm.common import table
from tablewise.llm.registry import query

# The terms are stated again, so that the SQL does not lean on the code under test.
SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1),
t AS (
  SELECT page_id, regexp_matches(low, '(^|[^a-z0-9])(adult|adults|bdsm|blowjob|camgirl|camgirls|camsex|cumshot|erotic|erotica|escort|escorts|fetish|gangbang|hardcore|hentai|hookup|incest|keygen|keygens|malware|milf|nsfw|onlyfans|phishing|porn|porno|pornos|pornhub|pornography|pornstar|pornstars|pornvideo|pornvideos|sexcam|sexcams|sexshop|sexvideo|sexvideos|softcore|spam|spammer|spyware|stripper|strippers|swinger|swingers|topless|torrent|torrents|trojan|upskirt|voyeur|warez|xvideos|xxx)([^a-z0-9]|$)') AS strict,
         len(list_filter(['ads', 'adserver', 'babe', 'babes', 'bet', 'bets', 'betting', 'bingo', 'blackjack', 'bonus', 'brides', 'cam', 'cams', 'cash', 'casino', 'casinos', 'cheap', 'cialis', 'click', 'coupon', 'coupons', 'crack', 'cracked', 'credit', 'crypto', 'dating', 'deal', 'deals', 'discount', 'discounts', 'download', 'downloads', 'drugs', 'enlargement', 'forex', 'free', 'gambling', 'gamble', 'girls', 'giveaway', 'hot', 'jackpot', 'kamagra', 'lesbian', 'levitra', 'loan', 'loans', 'lottery', 'lucky', 'mature', 'mortgage', 'naked', 'nude', 'nudes', 'offer', 'offers', 'payday', 'pharma', 'pharmacy', 'pill', 'pills', 'poker', 'popup', 'popups', 'prize', 'prizes', 'promo', 'promos', 'replica', 'replicas', 'rich', 'roulette', 'serial', 'sex', 'sexy', 'singles', 'slot', 'slots', 'steroids', 'strip', 'teen', 'teens', 'track', 'tracker', 'tracking', 'tramadol', 'viagra', 'vicodin', 'vip', 'voucher', 'vouchers', 'weight', 'win', 'winner', 'winners', 'wins'],
             lambda x: regexp_matches(low, '(^|[^a-z0-9])' || x || '([^a-z0-9]|$)'))) AS soft FROM p)
SELECT p.page_id, host, path, rule, coalesce(m.verdict, CASE WHEN strict OR soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id) JOIN t USING (page_id)"""


@query("op3_url_filter", SQL)
def op3(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
