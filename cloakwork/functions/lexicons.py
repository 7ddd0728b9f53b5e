"""Word lists that steer name detection, lower-cased.

These are fixed values: membership decides results.  Callers extend or replace them by
passing their own Lexicons; the longer kinds (places, sentence openers) are meant to be
extended by data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Fixed values.
AMBIGUOUS = _set(
    "frank mark will rose daisy lily grace hope faith joy art bill guy jack mason baker hunter rich loop sunny crystal"
    " dawn summer autumn jean jay ray dean earl max april may june august berlin king young long brown white green black"
    " gray cook fisher carpenter gardener an he wei han bin wan min lan yang song tang"
)
MAILBOXES = _set(
    "info support noreply no-reply donotreply sales admin contact hello team office help helpdesk service services billing"
    " accounts accounting hr jobs careers recruiting marketing press media abuse postmaster webmaster hostmaster"
    " mailer-daemon mail mailbox newsletter notifications notification alerts security privacy legal compliance finance"
    " orders order enquiries inquiries feedback subscribe unsubscribe root daemon test demo"
)
PARTICLES = _set(
    "von van der den ter ten zu zur zum af av de del della dello di da das dos du le la les los las y e bin ibn bint al el"
    " ul abu abd abdel abdul ben bat bar"
)
TITLES = _set(
    "mr mrs ms miss mx dr prof sir madam lord lady rev hon capt sgt col gen herr frau frl m mme mlle sr sra srta don dona"
    " dom sheikh shaikh sayyid sayed hajj haji imam mullah ustad shri smt kumari rav rabbi"
)
ROLES = _set(
    "customer client cardholder holder accountholder merchant buyer seller vendor supplier payee payer engineer technician"
    " developer administrator admin sysadmin agent representative operator analyst specialist consultant contractor"
    " supervisor dispatcher applicant patient recipient sender caller requester requestor assignee reporter claimant"
    " beneficiary nominee signatory witness tenant landlord passenger attendee guest member owner partner colleague"
    " candidate employee contact guardian kunde kundin mandant mandantin antragsteller antragstellerin sachbearbeiter"
    " sachbearbeiterin mitarbeiter mitarbeiterin ansprechpartner betreuer techniker ingenieur entwickler berater lieferant"
    " händler verkäufer käufer empfänger absender anrufer zeuge zeugin mieter vermieter eigentümer inhaber kontoinhaber"
    " karteninhaber begünstigter bewerber kollege kollegin"
)
ROLE_ABBREVIATIONS = _set("eng")
NON_NAMES = _set(
    "service services team department dept support care center centre desk group division unit account approval"
    " confirmation form review request ticket case report invoice payment refund order agreement contract policy portal"
    " system platform dashboard notification escalation priority status update summary reference ref manual guide document"
    " passport attachment schedule meeting project product feature version release server database network application"
    " module console license subscription balance transaction statement receipt hospital hospitals clinic clinics"
    " university universities college colleges institute institutes academy academies foundation foundations hotel hotels"
    " museum museums library libraries laboratory laboratories cathedral cathedrals avenue avenues road boulevard"
    " boulevards drive terrace terraces highway parkway access rights settings options credentials login permissions"
    " manager director lead head chief active inactive closed open pending resolved corp corporation inc incorporated ltd"
    " limited llc llp plc gmbh holding holdings systems industries technologies solutions enterprises ventures logistics"
    " pharmaceuticals consulting communications networks abteilung fachabteilung kundenservice kundendienst dienst"
    " vertrieb buchhaltung zentrale hotline geschäftsstelle niederlassung filiale reklamation beschwerde postfach leitung"
    " bereich gruppe stelle anfrage vorgang rechnung auftrag bestellung mahnung antrag konto nummer"
)
COUNTRIES = _set(
    "afghanistan albania algeria andorra angola argentina armenia australia austria azerbaijan bahamas bahrain bangladesh"
    " barbados belarus belgium belize benin bhutan bolivia botswana brazil brunei bulgaria burundi cambodia cameroon canada"
    " chile china colombia comoros congo croatia cuba cyprus denmark djibouti dominica ecuador egypt eritrea estonia"
    " eswatini ethiopia fiji finland france gabon gambia germany ghana greece grenada guatemala guinea guyana haiti"
    " honduras hungary iceland indonesia iran iraq italy jamaica japan kazakhstan kenya kiribati kosovo kuwait kyrgyzstan"
    " laos latvia lebanon lesotho liberia libya liechtenstein lithuania luxembourg madagascar malawi malaysia maldives mali"
    " malta mauritania mauritius mexico micronesia moldova monaco mongolia montenegro morocco mozambique myanmar namibia"
    " nauru nepal netherlands nicaragua niger nigeria norway oman pakistan palau panama paraguay peru philippines poland"
    " portugal qatar romania russia rwanda samoa senegal serbia seychelles singapore slovakia slovenia somalia spain sudan"
    " suriname sweden switzerland syria taiwan tajikistan tanzania thailand togo tonga tunisia turkey turkmenistan tuvalu"
    " uganda ukraine uruguay uzbekistan vanuatu venezuela vietnam yemen zambia zimbabwe"
)
#: Large cities; extend with Lexicons(cities=...).
CITIES = _set(
    "darmstadt mannheim heidelberg munich münchen hamburg frankfurt stuttgart düsseldorf dortmund essen leipzig dresden"
    " nuremberg nürnberg hannover hanover bremen wuppertal bielefeld bochum karlsruhe wiesbaden münster augsburg"
    " braunschweig chemnitz freiburg krefeld mainz aachen regensburg würzburg wolfsburg potsdam heilbronn göttingen koblenz"
    " ingolstadt cologne köln amsterdam rotterdam eindhoven utrecht antwerp brussels bruges ghent copenhagen aarhus"
    " helsinki oslo bergen gothenburg reykjavik zurich zürich lausanne wien salzburg graz innsbruck prague praha brno"
    " bratislava warsaw krakow wroclaw poznan gdansk budapest bucharest belgrade zagreb ljubljana lisbon porto madrid"
    " barcelona seville zaragoza malaga bilbao rome naples turin bologna venice genoa palermo athens thessaloniki istanbul"
    " ankara izmir dublin belfast glasgow edinburgh manchester liverpool birmingham leeds nottingham sheffield cardiff lyon"
    " marseille toulouse nantes strasbourg montpellier bordeaux lille rennes moscow kyiv kiev minsk riga tallinn vilnius"
    " tokyo osaka kyoto shanghai beijing guangzhou shenzhen wuhan seoul busan mumbai delhi bangalore hyderabad chennai"
    " karachi lahore dhaka bangkok jakarta manila hanoi taipei dubai riyadh tehran baghdad beirut casablanca nairobi lagos"
    " johannesburg toronto montreal ottawa vancouver chicago seattle atlanta boston detroit bogota lima quito caracas"
)
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"))
OPENERS = _set(
    "the a an this that these those each every any all some no both either neither another such one two my our your their"
    " his her its we i you they he she it who whom whose what which when where why is are was were be been do does did has"
    " have had will would shall should can could may might must as at in on of if for with by and or but so not here there"
    " ask reach forward call check see send set keep let find get take make give note contact review update email visit"
    " meet page ping message mention invite tell talk confirm verify ensure follow refer attach submit file cancel book fix"
    " escalate process raise log track monitor flag notify alert inform advise remind schedule ship deliver return open"
    " close complete approve reject receive create remove add apply use try read hi hey hello dear regards thanks thank"
    " also however therefore meanwhile regarding per via re from to sent subject date new best daily weekly today tomorrow"
    " yesterday first last next final current recent"
)
#: (words before the connector, connector): what follows such a pair is a person.
FRAMES = (
    (_set("escalated forwarded routed transferred reassigned redirected assigned referred handed delegated"), "to"),
    (
        _set(
            "eskaliert weitergeleitet weitergegeben übergeben zugewiesen umgeleitet weitergereicht delegiert verwiesen"
            " überwiesen"
        ),
        "an",
    ),
    (
        _set(
            "complaint inquiry enquiry request message email mail letter note notes call report submission feedback response"
            " reply query update notice notification"
        ),
        "from",
    ),
    (
        _set("beschwerde anfrage nachricht email brief notiz anruf bericht rückmeldung antwort mitteilung meldung feedback"),
        "von",
    ),
)
URL_WORDS = _set(
    "www meet api app apps user users profile profiles login logout signin signup register home index page pages view"
    " search about blog news docs doc static assets img images image cdn media files download downloads web public shared"
    " share join room rooms channel channels event events calendar settings config auth oauth sso go link links ref"
)
TOP_DOMAINS = _set(
    "com org net edu gov mil int info biz io co us uk de fr nl es it eu ca au ch at be se no dk fi pl ru jp cn in br pt ie cz"
)
PHONE_CUES = _set(
    "call called calling calls phone phoned phones mobile cell cellular cellphone contact contacted contacts reach reached"
    " reachable dial dialed dialled ring rang tel telephone whatsapp sms text texted"
)


def spelled_out(words: frozenset[str]) -> frozenset[str]:
    """words with their umlauts also written as two letters."""
    out = set(words)
    for w in words:
        for a, b in UMLAUTS:
            w = w.replace(a, b)
        out.add(w)
    return frozenset(out)


@dataclass(frozen=True)
class Lexicons:
    ambiguous: frozenset[str] = AMBIGUOUS
    mailboxes: frozenset[str] = MAILBOXES
    particles: frozenset[str] = PARTICLES
    titles: frozenset[str] = TITLES
    roles: frozenset[str] = ROLES
    role_abbreviations: frozenset[str] = ROLE_ABBREVIATIONS
    non_names: frozenset[str] = NON_NAMES
    countries: frozenset[str] = COUNTRIES
    cities: frozenset[str] = field(default_factory=lambda: spelled_out(CITIES))
    openers: frozenset[str] = OPENERS
    frames: tuple = FRAMES
    url_words: frozenset[str] = URL_WORDS
    top_domains: frozenset[str] = TOP_DOMAINS

    def extended(self, **more: Iterable[str]) -> Lexicons:
        """These lists plus words, lower-cased, by name of the list; cities also get their umlauts spelled out."""
        new = {}
        for name, words in more.items():
            added = frozenset(w.lower() for w in words)
            new[name] = getattr(self, name) | (spelled_out(added) if name == "cities" else added)
        return replace(self, **new)


DEFAULT = Lexicons()
