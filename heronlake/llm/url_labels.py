"""The small labelled table of URLs from which the filter learns: what to block (1) and what to allow (0), by hand."""

BLOCK = """
http://royal-casino.example.com/slots/welcome-bonus
https://www.lucky-roulette.example.net/en/jackpot.html
http://play.online-casino-club.example.org/register?aff=221
https://megaslots.example.com/free-spins/
http://m.sportbets24.example.net/live/odds
https://www.betting-tips.example.org/bonus/no-deposit
http://poker-palace.example.com/table/7?ref=pop
https://blackjack-king.example.net/win-cash-now
http://www.casinoroyale-bonus.example.org/vip/
https://bets-and-odds.example.com/en/promo/1204
http://jackpot-winner.example.net/claim.html
https://bingo-freebet.example.org/signup
http://www.winbig-casino.example.com/fr/2291
https://bookmaker-bets.example.net/de/offers
http://lottery-winners.example.org/prize/claim?id=9
https://free-lotto-tickets.example.com/
http://online-pharmacy-rx.example.net/buy/tablets
https://www.diet-pills-direct.example.com/order.html
http://pills4less.example.org/en/cart
https://cheapmeds-shop.example.net/no-prescription/
http://buy-tablets-cheap.example.com/discount/77
https://www.weightloss-pills.example.org/trial
http://herbal-enhancement.example.net/pills/
https://generic-drugstore.example.com/cheap-tablets
http://steroids-cheap.example.org/shop?item=4
https://miracle-slimming.example.com/de/5512
http://www.adult-dating.example.net/meet/tonight
https://xxx-videos.example.com/tube/1881
http://hot-webcams.example.org/live/
https://adultfilms.example.net/x/clips
http://sexy-singles.example.com/near-you.html
https://www.nude-pics.example.org/gallery/33
http://adult-tube-x.example.com/watch/992
https://escort-ads.example.net/city/4
http://xx-cams.example.org/en/join
https://adultchat.example.com/room/88?x=1
http://popup-ads.example.net/serve?slot=9
https://www.adserver-banner.example.com/imp/1x1.gif
http://click-tracker.example.org/r?u=811
https://ads.bannerfarm.example.net/zone/3
http://tracking-pixel.example.com/p.gif?uid=44
https://adtracks.example.org/beacon/9931
http://metrics-ads.example.net/collect?sid=1
https://www.trackads-network.example.com/sync
http://paidclicks.example.org/go/712
https://ad-exchange.example.net/bid/19
http://retarget-ads.example.com/track/open.html
https://spam-links.example.org/page/1.html
http://www.linkfarm-seo.example.net/backlinks/
https://article-spam.example.com/auto/1002
http://seo-linkfarms.example.org/buy-links
https://spamlist-bulk.example.net/mail/send
http://scraper-spam.example.com/copy/991.html
https://www.doorway-pages.example.org/kw/loans
http://keyword-farm.example.net/stuffing/4
https://bulk-mailer.example.com/offers/11
http://crack-keygen.example.org/download/full
https://www.warez-serials.example.net/crack/
http://free-cracked-games.example.com/torrent/12
https://fake-antivirus.example.org/scan-now.exe
http://update-flash-player.example.net/setup.exe
https://verify-account-login.example.com/secure/bank
http://www.prize-survey.example.org/winner/iphone
https://replica-watches.example.net/luxury/cheap
http://fake-handbags.example.com/outlet/sale
https://payday-loans-fast.example.org/apply
http://instant-cash-loan.example.net/approved?aff=5
https://getrich-quick.example.com/secret/method
http://crypto-doubler.example.org/invest/now
https://www.work-from-home-cash.example.net/join
http://casino-slots-club.example.org/bonus/spins
https://www.pokerbonus-cash.example.com/win
http://sportsbets-bonus.example.net/odds/free
https://roulette-casinos.example.org/jackpot/claim
http://online-slots-win.example.com/free-bonus
https://bestbets-casino.example.net/promo
http://cheap-pharmacy-pills.example.org/order/tablets
https://www.onlinepills-shop.example.com/cheap
http://slimming-pills-cheap.example.net/buy
https://rx-tablets-online.example.org/discount
http://xxx-cams-adult.example.com/live/girls
https://www.adult-webcams.example.net/chat/xxx
http://sexcams-dating.example.org/meet
https://nude-singles-dating.example.com/adult
http://adultvideos-tube.example.net/xxx/clips
https://ads-tracker.example.org/click/pixel
http://banner-ads-network.example.com/track
https://clickads-popup.example.net/serve/banner
http://tracking-ads.example.org/beacon/click
https://www.linkspam-farm.example.com/backlinks
http://seo-spam-links.example.net/buy/backlinks
https://bulkspam-mail.example.org/offers/cheap
http://keygen-cracks.example.com/warez/serial
https://cracked-warez-download.example.net/keygen
http://fast-cash-loans.example.org/apply/now
https://payday-cash.example.com/loans/instant
http://free-prize-winner.example.net/claim/cash
https://cheap-replica-shop.example.org/watches
http://bank-login-verify.example.com/account/secure
https://lotto-jackpot-winner.example.net/claim
"""

ALLOW = """
http://www.city-library.example.org/catalogue/item/204
https://history-notes.example.com/en/roman-roads.html
http://gardening.example.net/plants/roses/
https://blog.slow-cooking.example.com/soup/leek
http://math-lectures.example.org/algebra/lesson-4.html
https://news.riverside.example.net/local/2291
http://www.weather-report.example.com/coast/tuesday
https://museum-archive.example.org/paintings/17
http://court-rulings.example.net/2019/case/88.html
https://open-course.example.com/physics/waves
http://travel-diary.example.org/alps/day-3
https://www.film-critic.example.net/reviews/901
http://health-service.example.com/advice/vaccines
https://university.example.org/department/chemistry/staff
http://docs.compiler.example.net/manual/types.html
https://m.football-results.example.com/league/7
http://chess-club.example.org/openings/sicilian
https://www.village-school.example.net/calendar
http://bird-watching.example.com/species/heron
https://code-review.example.org/patch/4410
http://bridge-engineering.example.net/steel/design.html
https://recipes.example.com/bread/rye?page=2
http://www.railway-timetable.example.org/line/12
https://poetry-corner.example.net/fr/sonnets
http://parliament.example.com/debates/1881.html
https://astronomy.example.org/planets/saturn
http://blog.woodwork.example.net/chairs/oak
https://language-study.example.com/de/grammatik/3
http://www.farm-museum.example.org/tractors/
https://athletics.example.net/track/800m/results
http://wind-energy.example.com/turbines/offshore
https://winter-sports.example.org/ski/trails
http://adultery-in-literature.example.net/essays/5
https://www.adult-education.example.com/evening/classes
http://pillow-makers.example.org/cotton/
https://spanish-radio.example.net/es/noticias/44
http://better-writing.example.com/commas
https://alphabet-history.example.org/greek/beta.html
http://m.local-theatre.example.net/program/autumn
https://trackbed-walks.example.com/old/railways
http://insurance-law.example.org/claims/guide.html
https://www.free-software.example.net/licence/faq
http://archive.letters.example.com/1834/may
https://geology.example.org/rocks/granite
http://nature-reserve.example.net/path/map
https://philosophy.example.com/ethics/kant.html
http://www.children-books.example.org/authors/a
https://blog.mountain-hut.example.net/winter/opening
http://statistics-office.example.com/population/2020
https://sailing.example.org/knots/bowline
http://photography.example.net/lens/50mm?ref=index
https://www.opera-house.example.com/season/tickets
http://electric-trains.example.org/models/7
https://dictionary.example.net/en/word/thither
http://neighbourhood-council.example.com/minutes/12
https://thermal-baths.example.org/visit/
http://m.orchestra.example.net/concerts/brahms
https://economics.example.com/lecture/inflation.html
http://www.patents.example.org/search/hinge
https://fishing-village.example.net/harbour
http://mother-and-child.example.com/care/sleep
https://theatre-notes.example.org/hamlet/act-3
http://threads-and-yarn.example.net/knitting/
https://blog.northern-lights.example.com/photos/88
http://stonemasons.example.org/tools/chisel.html
https://www.marathon.example.net/training/plan
http://earth-science.example.com/oceans/tides
https://another-view.example.org/opinion/417
http://pottery.example.net/glaze/blue
https://southern-gardens.example.com/herbs/thyme
http://www.mathematics-olympiad.example.org/problems/2001
https://weaving.example.net/looms/
http://national-park.example.com/trails/north/3.html
https://m.transport.example.org/bus/41
http://cathedral.example.net/tower/history
https://nutrition.example.com/vitamins/c
http://blog.sentences.example.org/style/12
https://www.theology.example.net/texts/hebrew
http://station-clock.example.com/repair
https://tension-bridges.example.org/cables/
http://rational-thinking.example.net/en/logic
https://inland-waterways.example.com/locks/9.html
http://onion-soup.example.org/fr/recette
https://www.education.example.net/primary/reading
http://nation-and-state.example.com/essays/2
https://motion-study.example.org/pendulum?x=1
http://translation.example.net/de/verbs/
https://teaching.example.com/methods/5
http://mention-index.example.org/names/t
https://blog.lantern-making.example.net/paper
http://www.heath-and-moor.example.com/walks/6
https://leather-craft.example.org/belts/
http://other-worlds.example.net/novels/9.html
https://m.weathering.example.com/stone/report
http://gathering.example.org/folk/songs
https://threshing.example.net/harvest/1900
http://fifth-avenue.example.com/maps
https://www.ninth-symphony.example.org/score
http://tenth-century.example.net/kings/4
https://health-and-ethics.example.com/review/31
"""

#: Forms of a labelled URL: of its host's name, and of its path or a number.
FORMS = ("http://%s.example.net%s", "https://www.%s.example.com%s", "http://m.%s.example.org%s", "http://www.%s.example.net/es/%d#top")


def rows() -> list[tuple[str, int]]:
    """(url, label) of every line."""
    return [(url, label) for label, lines in ((1, BLOCK), (0, ALLOW)) for url in lines.split()]
