"""Terms of URLs that are not wanted; strict ones decide alone, soft
ones by the sum of their weights (1: common elsewhere too, 2: rarely elsewhere)."""

STRICT = tuple(
    # adult
    "porn porno pornhub xxx xvideos milf hentai camgirl camgirls livesex sexcam sexcams escort escorts bdsm nsfw "
    # gambling
    "casino casinos gambling slots sportsbook jackpot baccarat "
    # drugs without prescription
    "viagra cialis levitra xanax tramadol cheap-pills online-pharmacy "
    # copies, malware and fraud
    "warez torrent torrents cracked serialkey keygens malware phishing ransomware spam-farm linkfarm link-farm payday "
    "get-rich-quick work-from-home-jobs replica-watches essay-writing-service".split()
)

SOFT = dict.fromkeys(
    "adult sex sexy nude naked erotic webcam dating hookup fetish bet bets betting poker roulette bingo lottery wager "
    "pills pharmacy pharma meds steroids loan loans forex binary-options crypto-giveaway crack keygen serial nulled "
    "hack cheats spam doorway parked popunder adserver clickbait replica counterfeit seo-links backlinks traffic-exchange "
    "download-now free-download mp3-download full-movie watch-online leaked".split(),
    2,
) | dict.fromkeys(
    "free cheap win winner deal deals bonus promo offer offers discount coupon prize cash money credit debt rich earn ads "
    "ad track tracker click popup banner affiliate redirect download downloads stream streaming movie movies mp3 girls "
    "singles chat cam cams diet weightloss pill drug drugs tobacco vape casino-games play hot secret miracle".split(),
    1,
)

#: a sum of soft weights that blocks; no term has it alone
LIMIT = 3
