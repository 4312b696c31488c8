"""Personal information in free text: spans proposed by patterns, confirmed by validators, scored by context.

A pattern proposes a span with a base score. Validators (Luhn, mod-97 and number plans) raise or refuse it, words
near it raise or lower it, and what reaches THRESHOLD becomes a typed placeholder. Everything else in the text
stays as it is; placeholders hold no quote or backslash, so JSON stays JSON.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import tokens
from turnloom.llm.escapes import has_escapes, unescaped

THRESHOLD = 0.5
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Characters before and after a span that are searched for context words.
NEAR = 48


def luhn(digits: str) -> bool:
    """The check sum of card numbers and of several personal numbers."""
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits if c.isdigit()])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def register97(digits: str) -> bool:
    """The mod-97 check of registers: the last two digits are 97 less the rest modulo 97: French (15 digits) and Belgian (11 digits, from 2000 on with a 2 before them) registers."""
    d = re.sub(r"\D", "", digits)
    if len(d) not in (11, 15):
        return False
    body, key = d[:-2], int(d[-2:])
    return any(97 - int(x) % 97 == key for x in ((body, "2" + body) if len(d) == 11 else (body,)))


def spanish_letter(text: str) -> bool:
    """The letter that a Spanish identity number (8 digits, or X, Y, Z and 7) ends with."""
    t = re.sub(r"[^0-9A-Z]", "", text.upper())
    t = str("XYZ".index(t[0])) + t[1:] if t[:1] in ("X", "Y", "Z") else t
    return len(t) == 9 and t[:8].isdigit() and t[8] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(t[:8]) % 23]


# --- mail addresses -------------------------------------------------------------------------------------------

_AT = r"(?:@|＠|%40|&#64;|&commat;|\\u0040|\s*[\[({<]\s*(?:at|AT|@|ät)\s*[\])}>]\s*|\s+AT\s+)"
_DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|DOT|punkt|\.)\s*[\])}>]\s*|\s+DOT\s+)"
_MAIL = re.compile(rf"(?<![\w.%+@/-])([A-Za-z0-9](?:[\w%+'-]|\.(?=\w))*){_AT}((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{_DOT})+[A-Za-z]{{2,24}})(?![\w@])")
_MAIL_WORDS = re.compile(rf"(?<![\w.%+@/-])([A-Za-z0-9][\w.+-]*)\s+at\s+([A-Za-z0-9][A-Za-z0-9-]*(?:\s+dot\s+[A-Za-z0-9-]+)+)(?!\w)")
_MAIL_HINT = re.compile(r"[@＠]|%40|&#64;|&commat;|\\u0040|[\[({<]\s*(?:at|AT|ät)\s*[\])}>]|\sAT\s|\sat\s+[A-Za-z0-9][A-Za-z0-9-]*\s+dot\s")
_URL = re.compile(r"[a-z][a-z0-9+.-]*://", re.I)
#: What a URL doesn't hold.
_URL_ENDS = " \t\n\r\"'<>"
_SHELL_BEFORE = re.compile(r"(?:^|[\s\"'=(])(?:ssh|scp|sftp|rsync|mosh)(?:[ \t]+-\S+(?:[ \t]+[^\s@-][^\s@]*)?)*[ \t]+$", re.I)


def _mails(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _MAIL.finditer(text):
        after = text[m.end() : m.end() + 2]
        begun = max(text.rfind(c, 0, m.start()) for c in _URL_ENDS) + 1
        if _URL.search(text, begun, m.start()) or _SHELL_BEFORE.search(text, max(0, m.start() - 200), m.start()):
            continue  # the user part of a URL, however long, or of a remote shell
        if after[:1] == ":" and re.match(r":[\w~./]", after) and (m.group(1) == "git" or not after[1:2].isspace()):
            continue  # user@host:path of a repository remote
        if m.group(1) == "git":
            continue
        yield m.start(), m.end(), 0.9
    for m in _MAIL_WORDS.finditer(text):
        yield m.start(), m.end(), 0.7


# --- telephone numbers ----------------------------------------------------------------------------------------

_EXT = r"(?:\s*(?:,|;)?\s*(?:ext\.?|extension|x|Durchwahl|poste)\s*\d{1,6})?"
_PHONES = (
    # country code after + or 00
    (re.compile(rf"(?<![\w+./-])(?:\+|00)\s?[1-9]\d{{0,2}}(?:[\s./-]?(?:\(\d{{1,5}}\)|\d{{1,12}})){{1,6}}{_EXT}(?![\w])"), 0.7),
    # North American plan
    (re.compile(rf"(?<![\w+./-])(?:1[\s.-])?(?:\([2-9]\d{{2}}\)\s?|[2-9]\d{{2}}[\s.-])[2-9]\d{{2}}[\s.-]\d{{4}}{_EXT}(?![\w])(?![./-]\d)"), 0.6),
    # trunk prefix 0 and groups
    (re.compile(rf"(?<![\w+./-])(?:\(0\d{{1,5}}\)|0\d{{1,5}})[\s/-]\d{{2,5}}(?:[\s/-]\d{{2,5}}){{0,3}}{_EXT}(?![\w])(?![./-]\d)"), 0.55),
    # bare digits, which need a word beside them
    (re.compile(rf"(?<![\w+./:-])\d{{8,12}}{_EXT}(?![\w./-])"), 0.2),
)
_PHONE_WORDS = re.compile(r"\b(?:tel|telephone|telefon\w*|téléphone|tlf|phone|mobile|mobil|handy|cell|call|sms|fax|whatsapp|on-call|dial|anschluss|rufnummer|ring|rings|appel\w*|llama\w*|number is)\b", re.I)
_NOT_PHONE = re.compile(r"\b(?:version|build|order|ref|invoice|ticket|issue|pid|port|commit|hash|epoch|timestamp|node at|ip|requestid|uuid|isbn|ssn|social security|insurance|passport|personal number|account|iban|started at)\b[ :#=]*[\"'(\[#\d-]{0,4}$", re.I)


def _phones(text: str) -> Iterator[tuple[int, int, float]]:
    for pattern, base in _PHONES:
        for m in pattern.finditer(text):
            number = re.split(r"\s*(?:ext|x|Durchwahl|poste)", m.group(), maxsplit=1)[0]
            digits = sum(c.isdigit() for c in number)
            if not 8 <= digits <= 16 or len(set(re.sub(r"\D", "", number))) < 3:
                continue
            before = text[max(0, m.start() - NEAR) : m.start()]
            score = base
            if _PHONE_WORDS.search(before[-24:]):
                score += 0.4
            if _NOT_PHONE.search(before):
                score -= 0.5
            yield m.start(), m.end(), score


# --- identity numbers -----------------------------------------------------------------------------------------

_SOCIAL = r"(?:ssn|social[\s_-]?security(?:[\s_-]?(?:number|no\.?|nr\.?))?)"
_IDS = (
    # (pattern with the number in its last group, base score)
    (re.compile(rf"\b{_SOCIAL}\b[\s\"'`:=#]*(?:is\s+)?(\d{{3}}[ .-]?\d{{2}}[ .-]?\d{{4}})(?![\d-])", re.I), 0.9),
    (re.compile(r"(?<![\w./-])(\d{3}-\d{2}-\d{4})(?![\w-]|\.\d)"), 0.55),
    (re.compile(r"(?<![\w])([A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])(?!\w)"), 0.6),
    (re.compile(r"\b(?:national[\s_-]?insurance|nino)\b(?:[\s_-]?(?:number|no\.?))?[\s\"'`:=#]*([A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])(?!\w)", re.I), 0.9),
    (re.compile(r"\b(?:passport|reisepass|pasaporte|passeport)\b(?:[\s_-]?(?:number|no|nr|num|nummer))?\.?[\s\"'`:=#]*(?:is\s+)?([A-Z]{0,2}\d{6,9}[A-Z]?)(?!\w)", re.I), 0.9),
    (re.compile(r"\b(?:(?:id|identity|identification)[\s_-]?card|personalausweis|ausweis(?:nummer)?|carte d'identité|carta d'identità|dni|nie)\b(?:[\s_-]?(?:number|no|nr|num|nummer))?\.?[\s\"'`:=#]*(?:is\s+)?((?=[A-Z0-9]*\d)[A-Z0-9]{8,12})(?!\w)", re.I), 0.9),
    (re.compile(r"\b(?:personal[\s_-]?(?:number|no\.?|id)|personnummer|personnr|cpr(?:[\s_-]?(?:number|no\.?|nr\.?))?|fødselsnummer|henkilötunnus|pesel|bsn|codice fiscale|steuer-?id|cpf|nir|tax id)\b[\s\"'`:=#]*(?:is\s+)?((?:\d{2})?\d{6}[-+A]?\d{3}[\dA-Z]|\d{11}|\d{9}|\d{3}\.\d{3}\.\d{3}-\d{2})(?!\w)", re.I), 0.9),
    (re.compile(r"(?<![\w./-])((?:\d{2})?\d{2}(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])[-+]\d{4})(?![\w-])"), 0.3),
    (re.compile(r"(?<![\w./-])([12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2})(?![\w-])"), 0.2),
    (re.compile(r"(?<![\w./-])(\d{2}\.(?:0\d|1[0-2])\.[0-3]\d[-.]\d{3}[.-]\d{2})(?![\w-])"), 0.3),
    (re.compile(r"(?<![\w./-])((?:\d{8}|[XYZ]-?\d{7})-?[A-Z])(?![\w-])"), 0.1),
    (re.compile(r"(?<!\w)([A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z])(?!\w)"), 0.6),
)
#: The patterns of card numbers and of the Italian code, whose values may lack a run of digits.
_WITHOUT_RUNS = (5, 11)
_ID_WORDS = re.compile(r"\b(?:ssn|social security|passport|id card|identity|national|insurance|personal number|personnummer|register)\b", re.I)
_NOT_ID = re.compile(r"\b(?:order|ref|build|ticket|version|invoice|part|serial)\b[ :#=]*(?:no\.?|nr\.?)?[ #]*$", re.I)


def _ids(text: str, many: bool = True) -> Iterator[tuple[int, int, float]]:
    for pattern, base in _IDS if many else [_IDS[i] for i in _WITHOUT_RUNS]:
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex)
            before = text[max(0, start - NEAR) : start]
            score = base
            if base < 0.9:
                score += 0.3 * bool(_ID_WORDS.search(before)) - 0.5 * bool(_NOT_ID.search(before))
                value = m.group(m.lastindex)
                digits = re.sub(r"\D", "", value)
                # check digits of personal registers
                if len(digits) in (10, 12) and luhn(digits[-10:]) or register97(digits) and len(value) > 11:
                    score += 0.35
                elif spanish_letter(value):
                    score += 0.15
            yield start, end, score


# --- street addresses -----------------------------------------------------------------------------------------

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_TYPES = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Mews|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Boulevard|Blvd|Terrace|Close|Crescent|Gardens|Highway|Hwy|Parkway|Pkwy|Row|Walk|Hill|Grove|STREET|ROAD|LANE|AVENUE|AVE|MEWS|DRIVE)"
_TOWN = rf"(?:,?[ ]*(?:,|\n|\\n|\\\\n)?[ ]*(?:\d{{4,5}}[ ]+{_CAP}|{_CAP}(?:[ ]{_CAP})?[ ]+(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ ]\d[A-Z]{{2}}|\d{{4,5}}(?:-\d{{4}})?)\b))?"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)[ ]*\w{1,5},?[ ]+)?"
_REST = rf"(?:,[ ]*(?:Apt\.?|Apartment|Suite|Unit|Flat)[ ]*\w{{1,5}})?(?:,[ ]*{_CAP}(?:,[ ]*\d{{5}}\b|[ ]+[A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ ]\d[A-Z]{{2}}\b)?)?"
_ADDRESSES = (
    (re.compile(rf"(?<![\w.,/:-]){_UNIT}\d{{1,5}}[a-zA-Z]?,?[ ]+(?:(?:N|S|E|W|NE|NW|SE|SW)\.?[ ]+)?(?:{_CAP}[ ]+){{1,3}}{_TYPES}\b(?:\.(?=,))?{_REST}{_TOWN}"), 0.8),
    (re.compile(rf"(?<![\w.,/:-])\d{{1,4}}(?:[ ]?(?:bis|ter))?,?[ ]+(?:rue|avenue|av\.|boulevard|bd|place|impasse|chemin|allée|quai|route|cours)[ ]+(?:de[ ]la[ ]|du[ ]|des[ ]|de[ ]l['’]|de[ ]|d['’])?{_CAP}(?:[ -]{_CAP})?{_TOWN}"), 0.8),
    (re.compile(rf"\b(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrer|Rua|Via|Viale|Piazza|Corso)[ ]+(?:de[ ](?:la[ ]|los[ ]|las[ ])?|del[ ]|da[ ]|do[ ])?(?:{_CAP}[ ,]+){{1,3}}(?:n[.º°]?[ ]?)?\d{{1,4}}[a-zA-Z]?(?:,[ ]*\d{{1,2}}(?:º|°|ª|\\u00ba|\\\\u00ba)[ ]?\w?)?{_TOWN}"), 0.8),
    (re.compile(rf"\b[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|damm|ufer|straat|laan|gracht|plein|gatan|vägen|gata|vej|gade)[ ]+\d{{1,4}}[ ]?[a-zA-Z]?\b{_TOWN}"), 0.75),
    (re.compile(rf"(?<!\w)(?:P\.?[ ]?O\.?[ ]?Box|Post(?:al)?[ ](?:Office[ ])?Box|Postfach|Postbus|Postboks|Apartado(?:[ ]de[ ]Correos)?|Boîte[ ]postale|Casella[ ]postale)[ ]*(?:n[.º°]?[ ]?)?\d{{1,6}}\b(?:,[ ]*\d{{1,5}}[ ]+(?:{_CAP}[ ]+){{1,3}}{_TYPES}\b)?{_REST}{_TOWN}", re.I), 0.8),
)

def _addresses(text: str) -> Iterator[tuple[int, int, float]]:
    for pattern, base in _ADDRESSES:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), base


# --- names of persons -----------------------------------------------------------------------------------------

#: Frequent given names, lower case; one feature of a name among others, as what stands beside a name can do without it.
GIVEN = frozenset(
    """adam agnes ahmed aiko alan alba albert alejandro alice amara amina ana anders andré andrea andrew angela anita anna anne antonio
    arjun astrid aya barbara beatriz ben björn bram bruno camille carla carlos carmen caroline charles charlotte chen chidi chiara
    chloé christian clara daniel dario david diana diego dmitri elena elif elisa elizabeth emil emily emma erik eva ewa fatima felix
    fernando francesca freya fumiko giulia gustav hanna hanne hans hassan heidi helen helena henrik hiroshi ibrahim igor iker ines
    ingrid irina isabel ivan jacob james jan jana javier jean jennifer jens jessica johan john jonas jorge josé joseph julia
    kamal karin katarina kemal kenji klara kofi kwame lars laura leila lena li linda lotte luca lucia luis lukas maja malik
    marek margaret maria mario marta márta martin mary mateo mehmet mei michael miguel milan miriam mohammed mónica nadia naomi
    natalia nikolai nina noor olga oliver olivia omar oskar pablo patricia paul pedro peter petra pierre priya rafael rahul ravi
    rebecca robert rosa sabine samira sandra sanne sara sarah selma sofia søren stefan susan sven tariq thomas tomasz ulla ursula
    viktor vladimir wanda wei william xenia yara yasmin yuki yusuf zoë zoran zuzana
    aaron abigail adrian aidan aisha akira albrecht alec alejandra alessandro alex alexander alexandra alexis alfred alina allison alyssa amanda
    amelia amit amy andreas andrei angel angelo anil anja annika anthony anton antoine aoife archie ariana arthur ashley asuka audrey ava axel barry beatrice
    benedikt benjamin bernard bernd beth bettina bianca birgit bogdan boris brandon brenda brian bridget brigitte bryan caitlin caleb cameron carl carol
    caterina catherine cathy cecilia cedric chad chantal charlie chloe christa christina christine christoph christopher ciara claire claudia claudio colin connor
    craig cristina cynthia dale damian danielle daria darren dave deborah deepak denise dennis derek dieter dirk dominic dominik don donald donna dorothy douglas
    dylan edith eduardo edward edwin eileen eleanor elias elisabeth ella ellen emilia emmanuel enrique eric erika ernesto esther ethan eugene evan evelyn fabian
    federico felicia felipe ferdinand fiona florian franz fred frederick friedrich gabriel gabriela gareth gary gavin geoffrey george georgia gerald gerard
    gianluca gilles giovanni gloria gordon greg gregory guillaume gunther guy hannah harald harold harry hector heather heinrich henri henry herbert holger
    howard hugh hugo ian ilse imran inga ingo isaac isabella isabelle ismail jackie jake jakub janet janice jasmine jason jeff jeffrey jenny jeremy jerome
    jesús jill jim joan joanna joel joerg jonathan jordan josef josh joshua joyce juan juanita judith judy julian julie jürgen justin karen karl
    kate katharina katherine kathleen kathryn katie kay keith kelly ken kenneth kevin kim kirsten klaus kristina kurt kyle larry laurent lauren lawrence lea
    leah leo leon leonard liam lidia lillian lily lisa lorenzo louis louise lucas lucy ludwig lydia lynn mackenzie madeleine magdalena malcolm manfred
    manuel marc marcel marco marcus margot marianne marie marilyn marina marion marius mariusz markus marlene martina mathieu mats matteo matthew matthias
    maureen maurice maximilian megan melanie melissa michaela michel michele michelle mike mikhail mohamed monica monika monique morgan muhammad nancy natalie
    nathan nathaniel neil nicholas nick nicolas nicole nigel niklas nils noah nora norbert norman olaf olivier ololade owen pamela pascal patrick paula
    pauline peggy philip philipp philippe phillip piotr rachel raj ralf ralph ramon randy raymond regina reinhard renate renee ricardo richard rita robin
    rodrigo roger roland roman ronald rosemary ross roy rudolf russell ruth ryan sally salvatore sam samantha samuel sanjay scott sean sebastian sergei sergio
    shannon sharon shaun shawn shirley sigrid silvia simon simone sofia sonja sophia sophie spencer stanley stella stephan stephanie stephen steve steven stuart
    sunil suresh susanne suzanne sylvia tamara tanja tanya tara ted teresa terry theo theodore theresa thierry thorsten tiffany tim timothy tina tobias todd
    tom tony torsten tracy travis trevor tyler uwe valentina valerie vanessa vera veronica vicky victoria vijay vincent virginia vivian volker walter
    wayne wendy werner wilhelm wolfgang xavier yannick yolanda yvonne zachary""".split()
)
#: Given names that are everyday words as well; their family name must look like one.
WORDLIKE = frozenset("art autumn bill chase dawn drew faith frank grace grant hope iris jack joy june mark may miles pat penny ray rich rob rose ruby sky summer sue victor will".split())
#: Capitalised words of this domain that are no family names.
NO_FAMILY = frozenset(
    """adapter agent alert api apt assistant ave avenue batch board boundary bot branch budget build cache card case change chart check claude cleanup code collector
    commit complete config copilot coverage crash cron daily dashboard data day deploy desk digest directory drive editor email engine error
    event export feature file fix folder found generator graph group guide handler heatmap history hook hotfix http id import index
    ingest interface issue job key lane layer ledger legend library lint list loader log loop manager map matcher merge message mews migration mode
    model module monitor move name network nightly node note notes number object office ops option order owner package page palette parser patch path
    period phone pipeline place plan planner platform plugin point policy pool port private process product profile project public pull
    push python queue ranker read record region regression release reply report request reset resolver retry review road rollback rollup router rule
    run runner safe scheduler schema script search security server service session set setting setup shard sidebar square start state status
    step steward storage store street suite summary support sync system table tag task team terminal test ticket timeline timeout token tool tools
    tracker tree trigger turn type update upgrade usage user value version view visual watcher way web week widget will window worker workflow workspace write zone
    the and or not but for from with when then that this there they can could should would must may might has have had is are was were be been do does did
    monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december""".split()
)
#: Endings that family names often have.
_FAMILY_END = re.compile(r"(?:son|sen|ssen|ström|berg|stein|feld|mann|bach|burg|stad|strup|quist|qvist|lund|dahl|gaard|hoek|veld|stra|sma|inga|er|ez|es|az|ov|ova|ev|eva|in|ina|ski|ska|sky|cki|cka|wicz|icz|vić|vic|ić|ko|enko|iuk|yan|ian|dze|shvili|idis|akis|opoulos|escu|eanu|aru|ulu|oğlu|oglu|lar|etti|elli|ini|ino|one|ari|aro|arro|ardo|eau|aux|ier|ard|ont|ford|ton|ham|ley|worth|wood|field|well|man|smith|mere|orth|inde|ander|amura|moto|yama|kawa|saki|shi|awa|ering|aga|kova|ikova)$", re.I)
#: What stands right before a name: a title, words that a person follows, and words that other things may follow too.
_TITLE = re.compile(r"(?<!\w)(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Sr|Sra|Mme|Mlle)\.?|M\.)[ ]+$")
_PERSON_CUE = re.compile(r"(?:(?<!\w)(?:(?:reported|written|authored|reviewed|approved|submitted|opened|filed|raised|signed(?:[- ]off)?|prepared|requested|co-authored|assigned)[- ](?:by|to)|authors?|assignee|reporter|attn|(?:full|customer|client|patient|employee)[ _]name|dear|hello|hi|hola|bonjour|hallo|liebe[rs]?|sincerely|yours truly|regards|freundlichen Grüßen|cordialement|atentamente|my name is|I am|I'm|paired with|(?:talked|spoke|listened|reached out) (?:to|with)|met(?: up)? with|assign (?:it|this|that|them) to|bitte|it was|(?:person|who|author)(?=[\"']?:))\.?[\s\"'`:=,>*]{1,6}|(?:^|\n)--[ ]?\n)$", re.I)
_WEAK_CUE = re.compile(r"(?<!\w)(?:owner|contact|reviewer|maintainer|manager|customer|patient|employee|hey|thanks|cheers|cc|ask|this is|(?:from|to|name)(?=[\"']?:))[\s\"'`:=,*]{1,4}$", re.I)
#: What persons do, right after a name, and marks between which a value stands alone.
_ACTS = re.compile(r"[ ](?:said|says|asked|asks|wrote|writes|reported|reports|opened|opens|reviewed|reviews|approved|noticed|called|calls|wants|wanted|thinks|thought|suggested|joined|confirmed|mentioned|complained|complains|replied|told|needs|signed|pointed out|has (?:asked|said|written|reported|approved)|who|whose|fragen|meint|sagt|schrieb|schreibt|dit|écrit|dijo|escribió|pregunta|ha scritto|dice)(?!\w)")
_ALONE_BEFORE, _ALONE_AFTER = re.compile(r"(?:^|[\"'`;,|>\t\n(\[])[ ]?$"), re.compile(r"[ ]?(?:$|[\"'`;,|<\t\n)\]])")
_MAIL_AFTER = re.compile(r"[\s,:;-]{0,3}[<(\[]?(?:mailto:)?([\w.+-]+)(?:@|＠|%40|\s?[\[(]at[\])])")
_MAIL_BEFORE = re.compile(r"(?<![\w.+-])([\w.+-]+)@[\w.-]+[>)\]]?[\s,:;(-]{1,3}$")
#: Words that start a sentence, greet or entitle, and so are no given name of their own.
_NO_GIVEN = frozenset("bitte dr prof mr mrs ms herr frau sr sra mme mlle dear hi hello hey hola hallo bonjour thanks thank cheers regards sincerely kind best warm reported written reviewed approved assigned signed author please ask my our your his her their its an some any all each every new old in on at by to of as if so after before see also".split())
_PART = r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+"
_FAMILY = rf"(?:(?i:van(?:[ ]de[rn]?)?|von(?:[ ]der)?|de(?:[ ]la)?|da|di|del|la|le|ter|ten|bin|al)[ ])?{_PART}(?:-{_PART})?"
_PAIR = re.compile(rf"(?<![\w@.+/\\-])(?<!\w['’])({_PART}(?:-{_PART})?)((?:[ ][A-Z]\.)*)[ ]+({_FAMILY})(?![\w@(]|['’]\w|\.\w|_)")
_COMMA = re.compile(rf"(?<![\w@.+/\\-])(?<!\w['’])({_FAMILY}),[ ]?({_PART})(?:[ ][A-Z]\.)?(?![\w@(]|\.\w)")
def _cased(word: str) -> bool:
    return word[:1].isupper() and (word[1:].islower() or word.isupper() or "-" in word or "'" in word or "’" in word)


def _name_score(given: str, family: str, initials: bool) -> float:
    last = family.split(" ")[-1]
    g, f = given.lower(), last.lower()
    if not (_cased(given) and _cased(last)) or f in NO_FAMILY or f in GIVEN and g not in GIVEN:
        return 0.0
    known = g in GIVEN or g.split("-")[0] in GIVEN
    shaped = bool(_FAMILY_END.search(last))
    if g in WORDLIKE:
        return 0.3 + 0.4 * (shaped and len(last) > 4) + 0.2 * initials
    return 0.6 * known + 0.2 * shaped + 0.1 * initials


@lru_cache(maxsize=1)
def _vocabulary() -> frozenset[bytes]:
    """The words in lower case of a public vocabulary that are one token after a blank. Without its file, or with one that holds no words, nothing can be said of names, so this fails."""
    words = frozenset(t[1:] for t in tokens.ranks(None) if t[:1] == b" " and t[1:].decode("utf-8", "ignore").islower())
    if not words:
        raise ValueError(f"no words in {tokens.default_ranks()}")
    return words


@lru_cache(maxsize=1 << 16)
def everyday(word: str) -> bool:
    """Whether a word is often written in lower case, as names aren't: if its lower-case form is one token of a public vocabulary."""
    return word.lower().encode() in _vocabulary()


def _beside(text: str, start: int, end: int, given: str, family: str) -> float:
    """The score of a capitalised pair whatever its given name: what kind of words the two are, and what stands beside them.

    Words that are often written in lower case speak against a name; nothing is given to words that are no names.
    """
    last = family.split(" ")[-1]
    g, f = given.lower(), last.lower()
    if not (_cased(given) and _cased(last)) or given.isupper() or last.isupper() or f in NO_FAMILY or g in NO_FAMILY or g in _NO_GIVEN:
        return 0.0
    rare_g, rare_f = not everyday(given), not everyday(last)
    score = 0.2 * rare_g + 0.15 * rare_f + 0.1 * (rare_f and bool(_FAMILY_END.search(last)))
    before = text[max(0, start - NEAR) : start]
    if _TITLE.search(before) or _PERSON_CUE.search(before):
        score += 0.5 if rare_g or rare_f else 0.3
    elif _WEAK_CUE.search(before):
        score += 0.3
    if _ACTS.match(text, end):
        score += 0.3
    if _ALONE_BEFORE.search(before) and _ALONE_AFTER.match(text, end):
        score += 0.15
    if not (rare_g or rare_f):
        score = min(score, 0.4)  # two everyday words are a name only where a mail address says so
    for m in (_MAIL_AFTER.match(text, end, end + 2 * NEAR), _MAIL_BEFORE.search(before)):
        if m and any(len(w) > 2 and w in _folded(m.group(1)) for w in (_folded(given), _folded(last))):
            score += 0.5
    return score


def _folded(word: str) -> str:
    """A word as mail addresses write it: lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _names(text: str) -> Iterator[tuple[int, int, float]]:
    at = 0
    while m := _PAIR.search(text, at):
        given, family = m.group(1), m.group(3)
        score = _name_score(given, family, bool(m.group(2))) if given[0].isupper() else 0.0
        if score < THRESHOLD and given[0].isupper() and given.lower() not in WORDLIKE and (more := _beside(text, m.start(), m.end(), given, family)):
            # the list says nothing here, and a family name may be a given name too
            score = more + 0.1 * bool(m.group(2))
        if score >= THRESHOLD - 1e-9:
            yield m.start(), m.end(), score
            at = m.end()
        else:
            at = m.end(1)
    at = 0
    while m := _COMMA.search(text, at):
        family, given = m.group(1), m.group(2)
        at = m.end(1)
        last = family.split(" ")[-1]
        if given[0].isupper() and last[0].isupper():
            score = _name_score(given, family, False)
            if last.lower() not in GIVEN:
                yield m.start(), m.end(), score - 0.3 + 0.2 * bool(_FAMILY_END.search(last))


#: What every telephone number and all identity numbers but those of cards hold.
_DIGITS = re.compile(r"\d[\d\s./()+-]{4,}\d|\d{6}")
#: What every pair of capitalised words holds, and more: letters beyond ASCII count whatever their case.
_CAPS = re.compile(r"(?![a-z])[^\W\d_](?:[^\W\d_]|['’-])+(?:,[ ]?|(?:[ ][A-Z]\.)*[ ]+)(?:[A-Za-z]{2,3}[ ]){0,2}(?![a-z])[^\W\d_]")
_ORDER = {"email": 0, "address": 1, "national_id": 2, "phone": 3, "name": 4}


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """The non-overlapping (start, end, kind) of a text, in order; of overlapping ones the more telling kind stays."""
    if not text:
        return []
    if "\\" in text and has_escapes(text):
        plain, at = unescaped(text)
        return [(at[a], at[b], kind) for a, b, kind in spans(plain)]
    found: list[tuple[int, int, str]] = []
    if _MAIL_HINT.search(text):
        found += [(a, b, "email") for a, b, s in _mails(text) if s >= THRESHOLD]
    if re.search(r"\d", text):
        found += [(a, b, "address") for a, b, s in _addresses(text) if s >= THRESHOLD]
        many = _DIGITS.search(text) is not None
        found += [(a, b, "national_id") for a, b, s in _ids(text, many) if s >= THRESHOLD]
        if many:
            found += [(a, b, "phone") for a, b, s in _phones(text) if s >= THRESHOLD]
    if _CAPS.search(text):
        found += [(a, b, "name") for a, b, s in _names(text) if s >= THRESHOLD - 1e-9]
    if len(found) < 2:
        return found
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (_ORDER[x[2]], x[0], -x[1])):
        if all(b <= c or a >= d for c, d, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """text with the spans replaced by their placeholders."""
    if not found:
        return text
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _scan(with_text: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [spans(t) for t in df["text"]]
            out = {"src": df["src"], "row_id": df["row_id"], "kinds": [sorted({k for _, _, k in f}) for f in found]}
            if with_text:
                out["text"] = [redact(t, f) for t, f in zip(df["text"], found)]
            yield pd.DataFrame(out)

    return scan


def scanned(documents: DataFrame) -> DataFrame:
    """(src, row_id, kinds, text) of each row of (src, row_id, text): the kinds found and the text with placeholders.

    A map in Arrow batches without a shuffle: no key can be hot and no group is collected. NULL stays NULL and
    '' stays ''; whole texts are read whatever their length; repeated rows stay rows of their own.
    """
    return documents.select("src", "row_id", "text").mapInPandas(_scan(True), "src string, row_id bigint, kinds array<string>, text string")


def found(documents: DataFrame) -> DataFrame:
    """(src, row_id, kind): each kind that a row of (src, row_id, text) holds, once."""
    rows = documents.select("src", "row_id", "text").where("text is not null").mapInPandas(_scan(False), "src string, row_id bigint, kinds array<string>")
    return rows.select("src", "row_id", F.explode("kinds").alias("kind"))
