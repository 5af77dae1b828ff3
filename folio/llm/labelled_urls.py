"""The labelled URLs that the URL filter trains on by default: written by hand, no two of one host."""

from __future__ import annotations

#: Host and path of URLs to allow.
ALLOWED = """
www.cityherald.com/news/2023/05/council-votes-on-budget
library.northfield.edu/catalogue/search
www.meteo-alpes.fr/previsions/grenoble
docs.openmap.org/guide/install.html
en.encyclopaedia.org/wiki/Photosynthesis
blog.annas-kitchen.net/recipes/lentil-soup
www.physik.uni-waldstadt.de/forschung/publikationen
forum.bikerepair.co.uk/threads/chain-wear.4182
museum-of-glass.org/exhibitions/current
www.gov.islandia.is/ministries/education
journals.marine-biology.org/articles/coral-reef-decline
www.oldtownschool.k12.or.us/calendar
api.weatherdata.org/v2/reference
www.lasemana.es/cultura/literatura/poesia
shop.gardentools.com/products/pruning-shears
www.theatre-du-port.fr/programme/saison
archive.folkmusic.org/recordings/1956/ballads
developer.lumen-db.com/docs/queries
riverside-hospital.org/patients/visiting-hours
www.bundesarchiv-verein.de/findbuch/karten
news.astronomy-now.org/2021/11/comet-visible-tonight
www.trainspotter.org.uk/timetables/western
people.cs.easton.edu/~mhall/teaching/compilers
wiki.linuxhelp.org/Network_configuration
www.parks.gov/rivers/canoe-trails
community.knitting.com/patterns/wool-mittens
www.elpais-del-norte.es/economia/empleo
bakery-rosenthal.de/brot/roggen
www.historyofmaps.org/atlas/mercator
support.acme-printers.com/drivers/manual
www.mountainrescue.org/training/avalanche
lists.freecompiler.org/pipermail/dev/2019-March
www.philosophie-magazine.fr/articles/ethique
planetarium.museum.se/utstallningar
www.farmersweekly.net/crops/barley/disease
cooking.grandmas.org/bread/sourdough
www.stadtwerke-seeheim.de/fahrplan/linie4
tutorials.pythonschool.org/lesson/loops
www.kirkwoodchronicle.com/sports/football/results
data.statistics.gov.uk/datasets/population
www.choir-of-st-anne.org/concerts
blog.geology-notes.net/2018/02/basalt-columns
www.teatroreal-sur.es/temporada/opera
bookshop.papyrus.com/authors/translated-novels
www.oceanographic.int/reports/tides
www.radio-waldeck.de/sendungen/hoerspiel
law.cornbridge.edu/statutes/tenancy
www.chessclub-linden.at/partien
hiking.trails.ch/routes/matterhorn
www.sciencequarterly.org/issue/44/neutrinos
www.villageparish.org.uk/minutes/january
tools.unixmanual.net/man/grep
www.lemonde-des-plantes.fr/botanique/orchidees
www.wohnungsgenossenschaft.de/mieter/formulare
astronomy.stack.org/questions/1931/how-far-is-the-moon
www.railwaymuseum.be/collection/locomotives
www.diccionario-clasico.es/palabra/almena
www.firebrigade.org/safety/smoke-alarms
jobs.county-hospital.org/nursing
www.beekeeping.org.nz/articles/swarming
www.architecturereview.com/buildings/concrete-housing
www.zeitung-am-see.de/lokales/feuerwehr
www.universite-rivage.fr/faculte/medecine
www.soil-science.org/lectures/erosion
www.poetryfoundation.ie/poems/harbour
www.opensourcehardware.org/projects/oscilloscope
faculty.hillside.edu/math/linear-algebra
www.archaeology.gr/excavations/bronze-age
www.kinderbuch-laden.de/bilderbuch
www.mairie-saintpierre.fr/etat-civil
sailing.harbourclub.com/regatta/results
www.epidemiology.org/bulletin/measles
www.ayuntamiento-ribera.es/tramites
reviews.cameras.net/lenses/wide-angle
www.printmakers.org/workshops/etching
www.naturkundemuseum.de/sammlung/kaefer
www.energy-agency.org/statistics/wind-power
www.translators.ca/glossary/legal-terms
www.bridges-of-europe.eu/stone-arches
www.cinematheque.fr/films/muet
notes.databasejournal.org/transactions/isolation
www.veterinary-college.edu/animals/horses
www.woodworkers.org/joints/dovetail
www.lingua.it/grammatica/verbi
www.biblioteca-nacional.cl/manuscritos
www.climate-observatory.org/glaciers/retreat
www.gemeinde-oberau.at/buergerservice
www.fiddleschool.com/tunes/reels
www.newspaperarchive.org/1912/april
www.botanicgarden.org.au/plants/ferns
www.meteorites.net/catalog/iron
www.ceramics.jp/glazes/celadon
www.pediatrics.org/guidelines/fever
www.orchestra-rotterdam.nl/agenda
help.textproc.org/commands/sort
www.cathedral-school.org/history
www.lighthouse-keepers.org/logbooks
www.economics-letters.org/volume12/inflation
www.quilting.net/blocks/star
www.consumer-advice.gov.au/rights/refunds
www.tierheim-sued.de/hunde
www.bird-survey.org/species/kingfisher
www.sternwarte-jena.de/oeffnungszeiten
www.chateau-histoire.fr/visites/jardins
www.mathforum.org/problems/geometry
www.local-transport.dk/busser
www.typographers.org/specimens/garamond
www.fishery-board.no/quotas
www.anthropology.mx/etnografia
mirror.packages.org/pub/source/readme.txt
""".split()

#: Host and path of URLs to block.
BLOCKED = """
www.best-online-casino-bonus.com/free-spins
cheap-viagra-pills.biz/buy-now
hot-sexy-singles.xyz/cams/live
free-slots-jackpot.win/play
www.xxx-porn-videos.tube/hd/amateur
buy-cheap-meds-online.top/no-prescription
crack-keygen-download.info/serial
payday-loans-fast-cash.loan/apply-now
www.poker-betting-tips.bet/deposit-bonus
replica-rolex-sale.shop/cheap-watches
win-free-iphone-now.click/claim-prize
adult-webcam-girls.live/nude
torrent-warez-full.cc/cracked-games
www.bet-win-bonus.biz/register
get-rich-quick-crypto.site/double-bitcoin
buy-instagram-followers.pro/cheap-likes
weight-loss-miracle.club/free-trial
seo-backlinks-cheap.top/buy-links
escort-girls-vip.xyz/hot
cialis-online-pharmacy.ru/discount
megaslots777.win/free-credits
xxxsex-tube.me/videos/teen
click-here-winner.xyz/?prize
download-free-cracks.net/keygen.exe
lottery-winner-claim.top/collect-cash
sports-betting-pro.bet/free-tips
online-roulette-cash.casino/bonus
www.fast-cash-advance.biz/bad-credit-loan
nude-cam-chat.sex/free
cheap-replica-handbags.shop/sale-70-off
ad-click-tracker.xyz/redirect
spam-mailer-bulk.ru/buy-leads
hacked-accounts-shop.cc/netflix
serial-crack-patch.ru/photoshop-full
bingo-bonus-free.win/signup
milf-dating-sex.xyz/join
forex-profit-robot.biz/earn-money-fast
steroids-for-sale.top/buy-cheap
www.cheap-essay-buy.xyz/order-now
adserver-popups.click/banner-ads
link-farm-directory.biz/add-url
xrated-movies.tube/porn-free
casino-royal-vip.bet/jackpot
win-big-slots.casino/free-bonus
viagra4u-discount.ru/cheap
sexdating-hookup.live/adult
work-from-home-cash.click/make-money
bitcoin-doubler-free.xyz/invest
diet-pills-fast.shop/lose-weight
earn-cash-surveys.top/free-gift
fake-passport-buy.cc/documents
game-cheats-hack.xyz/unlimited-coins
clickbait-viral-ads.info/shocking
porn-pics-gallery.xxx/nude
credit-fix-fast.loan/bad-credit
pills-without-prescription.biz/xanax
freeporn-hd.sex/hardcore
online-betting-odds.win/freebet
tracking-pixel-ads.click/track
spy-phone-hack.top/download-free
cheap-cigarettes-sale.ru/buy
lucky-spin-jackpot.casino/win
hot-deals-discount.click/90-off
hookers-escorts-city.xyz/vip
crypto-pump-signals.biz/guaranteed-profit
torrents-cracked-apps.cc/full-free
instant-loan-approval.loan/cash-today
adult-toys-sex.shop/xxx
penis-pills-max.biz/enlarge
replica-shoes-outlet.top/cheap
bonus-code-casino.bet/free-chips
win-lotto-today.xyz/winner
buy-fake-reviews.pro/cheap
doorway-spam-pages.info/keywords
erotic-massage-girls.live/hot
make-money-online-fast.site/click
keygen-serials-free.ru/crack.zip
betting-bonus-vip.win/sports
cheap-tramadol-online.biz/order
nude-celebs-leaked.xxx/pics
popup-ads-network.xyz/adclick
free-gift-card-claim.click/amazon
slots-vegas-online.casino/deposit
mega-porn-tube.sex/free-videos
debt-cash-loan.biz/apply
hot-teens-cam.live/sexchat
cracked-software-full.cc/download
cheap-luxury-replica.shop/bags
bet365-bonus-free.bet/win
spam-traffic-bot.ru/buy-traffic
miracle-cure-pills.top/discount
xxx-adult-dating.xyz/free-join
poker-chips-free.casino/jackpot
hack-wifi-password.click/free-download
quick-cash-win.top/prize
buy-pills-cheap.ru/rx
free-sex-cams.live/xxx
viral-ad-clicks.info/popunder
seo-spam-links.biz/farm
bestbets-vip.win/bonus
""".split()

#: Suffixes that say nothing of the kind.
PLAIN = ("com", "net", "org", "info", "example.com", "example.net", "example.org", "de", "co.uk")


def _both(kind: list[str], blocked: int) -> list[tuple[str, int]]:
    """Each URL as it is written, and once more under a plain suffix with its ``www.`` put or taken, so that neither is a tell."""
    out = []
    for i, u in enumerate(kind):
        host, path = u.split("/", 1)
        name = host.rsplit(".", 1)[0]
        other = name.removeprefix("www.") if name.startswith("www.") else f"{('www', 'blog', 'm')[i % 3]}.{name}"
        out += [(f"http{'s' * (i % 2)}://{u}", blocked), (f"http{'s' * (1 - i % 2)}://{other}.{PLAIN[i % len(PLAIN)]}/{path}", blocked)]
    return out


#: (url, 1 to block): two of each entry, one after the other.
LABELLED = tuple(_both(ALLOWED, 0) + _both(BLOCKED, 1))
