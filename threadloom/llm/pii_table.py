"""The small labelled table from which the model of personal information is trained.

Sentences are carriers with slots; what fills a personal slot is labelled with its kind. Carriers and neutral sentences
were written for this table from general knowledge of letters, forums and forms; none is taken from a text the operator
is run on. Fillers are made by rule from a fixed seed, so the table is the same everywhere; nobody real is in it.

Every fifth carrier and neutral sentence belongs to the held-out part: `labelled_table(part="train")` has none of them,
`part="held"` only them, so that quality is measured on sentences the model has never seen.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")
HELD = 5  # one carrier in so many is held out

#: Common given names of several languages.
GIVEN = """Adam Adrian Agnes Ahmed Aisha Alain Alan Albert Alexander Alice Amina Amir Amy Ana Andrea Andrei Andrew Anita Anna Anne Antonio Arthur Astrid
Barbara Beatrice Ben Benjamin Bernd Birgit Boris Brian Bruno Camille Carl Carlos Carmen Caroline Catherine Charles Charlotte Chen Chloe Christian Claire Clara
Claudia Colin Daniel David Deepak Diana Diego Dmitri Dorothy Edward Elena Elizabeth Emil Emily Emma Erik Esther Eva Fabian Farid Fatima Felix Fernando Fiona
Francesca Francis Frank Freya George Gerhard Giovanni Grace Greta Hana Hannah Hans Harold Hassan Heidi Helen Henry Hiro Hugo Ian Ibrahim Igor Ines Ingrid Irene
Isabel Ivan Jack Jakob James Jane Javier Jean Jens Joan Johanna John Jonas Jorge Joseph Juan Julia Karen Karim Karl Kate Katrin Kenji Kevin Klara Klaus Kofi
Lars Laura Leila Lena Leo Linda Louis Lucas Lucia Luigi Magda Marco Margaret Maria Marie Mario Mark Martin Mary Matteo Maya Michael Miguel Mina Mohammed Monica
Nadia Nathan Nicole Nikolai Nina Noah Nora Olga Oliver Omar Oscar Otto Pablo Patricia Paul Pedro Peter Petra Philip Pierre Priya Rachel Raj Ravi Robert Rosa
Ruth Sara Simon Sofia Stefan Susan Sven Tariq Teresa Thomas Tim Tomas Valentina Vera Victor Walter Wei William Yuki Yusuf Zoe""".split()
TITLES = ["Dr.", "Ms", "Mr", "Mrs", "Prof.", "Herr", "Frau", "Mr.", "Ms.", "Mrs.", "Señora", "Madame"]

#: Sentences with a personal slot. Other slots are as in NEUTRAL.
CARRIERS = {
    "email": """Please forward the report to {}.|Questions go to {}, not to the forum.|Her new account is {} since March.|Drop a line to {} when you are ready|Registered with {} two years ago.|the bounce came back from {}|Write {} for access.|I used {} as the login.
Invoices belong to {} only.|E-mail: {}|email {} instead|To: {}; Subject: backup|Bugs? {}|Maintainer: {}|{} did not reply.|{} bounced twice today, so try later.|Add {} to the mailing list, please.|they asked to copy {} on everything|Escribe a {} si tienes dudas.
Schreib bitte an {}, dann klappt es.|Écrivez à {} pour la suite.|Correo: {}|git config user.email {}|Signed-off-by: {}|Their old mailbox was {} until last year.|[{}]|{}|({})|{}|Any question: {}|Is {} still valid?|My mail, {}, is on the website.|The {w} sends a warning to {} whenever it stops.|subscribe with {} and wait""",
    "phone": """Phone: {}|Mobile {}|Give me a ring at {}.|If it burns, dial {} at once.|the hotline is {} (24 hours)|My number is {}.|Reach the office on {}, extension 4.|Telefon {}|Tel. {}|Teléfono: {}|Llámame al {} mañana.|Ruf mich unter {} an.|Appelez le {} avant midi.|fax {}
SMS to {} works best|He left {} on the answering machine.|Support can be reached at {} between nine and five.|I phoned {} but nobody picked up.|{} is my desk.|{} rings forever|Signal or Telegram: {}|Emergency contact {}|the number {} is printed on the back|{}|({})|{}|{}, evenings only.|Why does the {w} refuse {} as a number?
For urgent cases there is {}.|We got a missed call from {} at noon.|Is {} a landline?|send a message to {} and wait|my phone, {}, was stolen|They gave {} to the wrong customer.""",
    "id_number": """My {} was stored in plain text.|Why does the check refuse {}?|The clerk typed {} twice.|{} shows up in the backup as well.|Enter {} and press return.|somebody posted {} in the channel|The field accepts {} but not lower case.|El formulario no acepta {}.|Meine {} steht im Protokoll.|The sample row has {}.
Customer file: {}|{}|({})|validation of {} ends in an error|please delete {} from your reply|I only have {} with me|the letter quotes {} in the header|{}|With {} the lookup works.|Our form prints {} at the bottom, which it should not.|{} is mine.|Is {} too long for the column?|They matched {} against the register.|he sent {} unencrypted""",
    "address": """Send the package to {}.|Our office moved to {} in June.|You will find us at {}.|Address: {}|He lives at {}, third floor.|The parcel for {} came back.|Navigate to {} and it shows a lake.|Billing address {}|The map centers on {} by default.|We meet at {} on Friday.|Wohnhaft in {}.|Mi dirección es {}.|J'habite {}.
The customer at {} has no fibre.|Try {} as the test input.|the store near {} has it|Return it to {} within ten days.|{} is not found by the lookup.|From {} it is a short walk.|{}|({})|{}|My flat is {}.|the courier needs {} in one line|Why is {} split into two fields?|They delivered to {} although I was away.|Her shop is in {}, next to the bank.|the old place was {}|letters go to {} now""",
    "name": """Best, {}|Cheers, {}|Kind regards {}|-- {}|Written by {}|© {}|{} wrote:|as {} pointed out, the {w} is {W}|thanks to {} for testing|Talk to {} about it.|My colleague {} found the cause.|I asked {} and got no answer.|Mit freundlichen Grüßen {}|Gracias a {} por la ayuda.|Merci à {} pour son aide|The account belongs to {}.
{} and I rewrote it.|{} will be on leave.|Reviewer: {}|Author: {}|The late {} started the project|her name is {}|a talk by {} explains that|{} (maintainer)|Is {} still around?|We hired {} in May.|the form was filled in by {} in person|the book of {} has a section on it|Hi {},|Dear {},|PS: {} says hello|{}|({})|{}
Yesterday {} showed me another way.|This comes from a mail of {} to the list.|In the minutes {} is named as the owner.|Only {} may merge this.|The idea was first described by {}.|I work with {} on the {w}.|Did {} ever fix the {w}?|The ticket of {} was closed.|My name is {} and I run the {w}.|ask {} or me|{} reported it, too.|{} thinks so as well.|a letter signed {}|on behalf of {}|I am {}, new here.|the profile of {} cannot be opened
Everything in this folder was made by {}.|We still wait for {} to confirm.|When {} left, nobody took over the {w}.|The first draft is from {}, the second from me.|According to the log, {} was the last to {v} it.|Sincerely, {}|Yours, {}|{}, our admin, has the password.|Sorry {}, my mistake.|You may want to meet {}.|Photo: {}|Speaker: {}|Contact person is {}.|Has anyone talked to {}?|{} asked for a {W} {w}.
Then {} suggested {c}.|It was {} who found it.|I share the room with {}.|This is how {} explains it.|The review by {} was helpful.|The complaint came from {}.|{} and the rest of the team agree.|the row for {} is empty|Both {} and the vendor know.|{} has moved to another team.|Every user but {} can log in.|Please give {} access to {f}.|Frag {}, wenn du nicht weiterkommst.|{} hat das geschrieben.|Lo escribió {}.|Demande à {}.|no word from {} yet|as taught by {}""",
}
CARRIERS = {k: [c for line in v.split("\n") for c in line.split("|")] for k, v in CARRIERS.items()}

#: Sentences without personal information: w noun, W adjective, P product, n number, f path, i identifier, h code, c call, v verb, x hash, u user handle, L place-like product of two words.
NEUTRAL = """
I get error {h} as soon as the {w} grows beyond {n} rows.|Why is my {w} so {W} after the update to {P} {n}?|The {w} was {W} even before I touched {f}.|Delete {f}, then start {P} again.|You could also {v} the {w} with {c}.|Does {c} still {v} the {w} in version {n}?|See the notes on {P} {n} for why it went away.
@{i} thanks, that did it.|@{i} no, I use {P}.|@{u} could you post the whole {w}?|First check that {f} exists, second that {c} returns {n}.|It fails on {P} but works on {L}.|{L} is the name of our test cluster.|{L} and {L} ship the same {w}.|Our product {L} uses a {W} {w}.|We compared {P} with {L} for a month.|The new {L} release breaks my {w}.
Between 10:{s} and 11:{s} nothing was written.|The build {n} took {n} seconds on a machine with {s} cores.|Port {n} is taken, so I moved it to {n}.|The host 10.0.{s}.{s} does not answer.|ping 192.168.{s}.{s} shows no loss|Version {n}.{s}.{s} is out since 20{s}-0{r1}-1{r1}.|Commit {x} introduced it.|sha1 {x}{x} does not match|The order {D} was shipped.|Invoice {d}-{s} is still open.
ISBN 978-{r1}-{d}-{s}-{r1} covers it in chapter {s}.|Issue #{d} has the details, see also #{d}.|My score went from {n} to {n}.|The id column holds {D} and {D}.|Row {n} of {n} was skipped.|Room {s} has no socket.|In 20{s} there were {n} of them.|Add {n} grams, wait {s} minutes.|Add rows {s}, {s} and {s}.|The serial number {D} is printed below.|timeout after {D} ms|ISBN {d}-{s}-{d}-{r1} is out of print.|The ISSN is {r4}-{r4}.|See ISBN 3-{s}-{d}-{r1}, page {s}.|DOI 10.{r4}/{i}.{d}
Use {i}@{s} or pin {w}=={n}.|The decorator @{i} must come first.|npm i @{i}/{i}@{n} fails|user@host:~$ {v} {f}|ssh root@{i} works, {i} does not|The hashtag and the @ sign both need quotes.|He said at most {n} at a time.|Look at {c} dot chaining instead.|meet at {n} sharp|The street layer of the map is empty.|A road name may be null.|Every address in memory is {W}.
Unit tests pass, unit {s} fails.|The apartment dataset has {n} rows and {s} columns.|Phone support was not helpful.|Call {c} before you {v} the {w}.|Mail gets stuck in the {w}.|My name server is {W}.|Passport is a library for logins.|The passport middleware throws {h}.|The licence of {P} forbids that.|A social security field must be masked.|Identity columns are {W} in {P}.|The tax module of {P} rounds to {n} digits.
Best regards|Best wishes|Thanks a lot|Cheers|Hi all,|Dear team,|Written in {P} {n}.|Written by the {w} itself.|Reviewed twice, no change.|Author unknown.|The author of {P} agrees.|Kind of slow, but fine.|Talk to the {w} team.|Ask the {P} people about it.|Is {P} still around?|Did {P} ever fix the {w}?|I asked twice and got no answer.|On behalf of the {w} process it runs {c}.
Monday March 3|Windows Server is {W} here.|Google Chrome and Mozilla Firefox differ.|New York has its own time zone.|Visual Studio cannot find the {w}.|The United Nations list has {n} entries.|Stack Overflow had the same question.|Apache Spark reads {f} in {n} seconds.|Machine Learning is not needed for this.|Big Data is a {W} word.|The Quick Start guide says {v}.|Silver Lake was the code name.|Both Red Hat and Open Suse are fine.
SELECT {i}, count(*) FROM {i} WHERE {i} > {n}|for {i} in range({n}): {c}|{i} = {i}.{i}({n}, "{w}")|if {i} == {n} then return {h} end|def {i}(self, {i}={n}):|$ {v} --{w} {f} -n {n}|curl -X POST http://localhost:{n}/{i}|import {i} as {i}|return {i}[{n}] + {i}|<{i} {i}="{n}">|{i}: {i}|const {i} = await {c};
While the {w} is {W}, {P} will {v} it.|As long as it is {W}, {P} cannot {v}.|Whenever the {w} gets {W}, {P} tries to {v} the {w}.|Unless {f} is {W}, {P} stops.|Since the {w} was {W}, {P} had nothing to {v}.|If {v} is {W}, {P} has a bug.|Because the {w} is {W}, {P} skips it.|It ended, {P} did not.|The {w} became {W}. {P} did not notice.|Now it runs on {P}. Still, the {w} is {W}.|That was {P}. This is {P}.
El {w} {W} no responde.|Un {w} {W} puede {v} otro {w} {W}.|Cada {w} {W} ocupa {n} bytes.|Cambié el {w} {W} por uno nuevo y ahora funciona.|No conviene {v} un {w} {W} dos veces.|El borde grueso del dibujo ocupa demasiado espacio.|Una tapa lateral abierta deja pasar el polvo fino.|Quitar el aviso grande y la regla vieja ayudó bastante.|El tejido simétrico sirve para hilos paralelos.
Ich musste den {N} dreimal {v} und danach neu laden.|Der Rechner ließ sich nicht herunterfahren, obwohl keine Anwendung lief.|Ein beschädigter {N} muss vollständig ersetzt werden.|Nachdem ich alles mehrmals verschoben und umbenannt hatte, ging es.|Vorübergehend hilft auch abschalten und wieder einschalten.|Der eingebaute {N} darf niemals gleichzeitig {v}.
What does {h} mean?|Once it is {W}, {P} starts again.|Being {W}, {P} gives up.|If it stays {W}, {P} and {P} wait.|The setting may be {W}, {W} or {W}.|In {P}, {c} is {W}.|Install {P} from {P}, not from {P}.|{P} calls {P}, {P} calls {c}.|Use a {W} {w}, {v} it, then {v} {f}.|It depends on the {w}.|Not reproducible on my side.|Works for me.|This answer is wrong since {P} {n}.|Please show the content of {f}.|I do not have a {w}.|There is no need to {v} anything.|It is {W}, that is all.|Never mind, found it.|Same here with {P} {n}.|Is it possible to {v} a {w} twice?|How can I {v} the {W} {w} without losing the {w}?|A {W} {w} can {v} up to {n} times per second, which is enough for most uses.
When I {v} the {w}, all values become {n}.|After some hours the {W} {w} begins to {v} and memory reaches {n} MB.|We are three people and look after {n} machines with {P}.|The documentation of {c} is {W}, so I read the source in {f}.|What I want: one {w} per {w}, sorted by {i}.|What happens: the {w} is {W} and {P} prints {h}.|As a workaround, {v} the {w} every {n} minutes.|My guess is that {P} keeps the {w} open while {c} is running.|I tried {c}, {c} and {c}; none of them {v} the {w}.
¿Cómo puedo {v} el {w} sin perder {f}?|El {w} tarda {n} segundos con {P} {n}.|No encuentro el {w} en {f}.|La tabla tiene {n} filas y {s} columnas.|Gracias, era el {w}.|Probé {c} y sigue igual.|Con la versión {n} de {P} aparece error {h}.|¿Por qué {P} no guarda el {w} {W}?|Hay que {v} primero el {w}.|Si el {w} está {W}, {c} devuelve {n}.
Wie kann ich den {N} ohne {P} {v}?|Der {N} ist seit Version {n} sehr {W}.|Die Tabelle hat {n} Zeilen und {s} Spalten.|Danke, es lag am {N}.|In {f} steht nichts davon.|Mit {c} geht es nicht, weil der {N} {W} ist.|Seit Montag meldet {P} den Fehler {h}.|Bitte den {N} neu starten und {f} löschen.|Warum braucht der {N} auf {P} {n} Sekunden?|Ein {W} {N} reicht für {n} Einträge.
Comment {v} le {w} sans perdre {f} ?|Le {w} met {n} secondes avec {P} {n}.|La table a {n} lignes.|Merci, c'était le {w}.|Il faut relancer {P} après chaque {w}.|Come posso {v} il {w} con {P}?|Il {w} non funziona dopo la versione {n}.
"""
NOUNS = "server file query table column backup plugin window button record job worker token node volume script form list page image graph model database folder archive printer router session account report field string value loop socket archivo servidor tabla fichier Datei".split()
ADJECTIVES = "slow empty large small broken new old fast strange wrong correct hidden missing stable noisy heavy simple lento grande vacío leer langsam lent".split()
VERBS = "load save open close start stop convert compare filter sort split join export import compile install remove update parse render resize cargar guardar laden speichern ouvrir".split()
COLORS = "Red Blue Green Silver Golden Black White Amber Grey Crimson Bright Silent Open Rapid Solid North Quick Wild Deep Iron".split()
THINGS = "Lake River Hill Stone Harbor Bridge Cloud Fox Forest Tower Gate Falcon Ridge Valley Shore Wave Star Wind Engine Studio".split()


class Maker:
    """Fillers by rule."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def invented(self, least: int = 2, most: int = 3) -> str:
        onset = "b br c cr d dr f fl fr g gl gr h j k kl l m n p pl pr qu r s sk sl st t tr v w z sh ch th".split()
        coda = ["a", "e", "i", "o", "u", "ai", "ou", "ea", "ie", "an", "en", "in", "or", "ar", "el", "and", "ick", "ost", "er", "ix", "on", "um", "al", "ett"]
        return "".join(self.pick(onset) + self.pick(coda) for _ in range(self.r.randint(least, most)))

    def family(self) -> str:
        ends = ["", "", "", "son", "sen", "berg", "mann", "man", "er", "ini", "etti", "ova", "ov", "ski", "ez", "es", "ton", "ford", "ley", "worth", "wood", "field", "stein", "bauer", "escu", "ic", "ian", "well", "hart", "strom", "lund", "gaard", "ier", "eau", "ura", "moto"]
        one = (self.invented(1, 2) + self.pick(ends)).capitalize()
        return one + "-" + self.invented(2, 2).capitalize() if self.r.random() < 0.12 else one

    def given(self) -> str:
        return self.pick(GIVEN) if self.r.random() < 0.55 else self.invented(1, 2).capitalize()

    def name(self) -> str:
        g, f, x = self.given(), self.family(), self.r.random()
        if x < 0.36:
            return f"{g} {f}"
        if x < 0.46:
            return f"{self.pick(TITLES)} {g} {f}"
        if x < 0.54:
            return f"{g} {self.pick('ABCDEFGHIKLMNOPRSTVW')}. {f}"
        if x < 0.63:
            return f"{g[0]}. {f}"
        if x < 0.71:
            return f"{g} {f[0]}."
        if x < 0.79:
            return f"{f.upper()}, {g}"
        if x < 0.97:
            return f"{g} {f}".lower()
        return f"{g} {f}".upper()

    def email(self) -> str:
        user = self.pick([lambda: f"{self.given()}.{self.family()}".lower(), lambda: f"{self.invented()}{self.r.randint(1, 999)}", lambda: f"{self.given()[0]}_{self.family()}{self.r.randint(1, 99)}".lower(), lambda: f"{self.family()}+{self.pick(NOUNS)}".lower(), lambda: f"{self.given()}-{self.invented()}".lower()])()
        hosts = [["example", "org"], ["example", "com"], ["example", "net"], ["mail", self.invented(2, 2), "example"], ["post", self.invented(1, 2), "test"], ["office", self.invented(2, 2), "invalid"], [self.invented(1, 2), "example"], [self.invented(1, 2), "de"]]
        host, x = self.pick(hosts), self.r.random()
        if x < 0.6:
            out = f"{user}@{'.'.join(host)}"
        elif x < 0.72:
            out = f"{user} @ {'.'.join(host)}"
        else:
            at, dot = self.pick([("(at)", " dot "), ("(at)", " [dot] "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("[at]", "(dot)"), (" (at) ", " (dot) ")])
            out = f"{user}{at}{dot.join(host)}"
        out = out.upper() if self.r.random() < 0.1 else out
        return f"<{out}>" if self.r.random() < 0.1 else out

    def phone(self) -> str:
        d = self.digits
        return self.pick([
            lambda: f"+44 1632 960{d(3)}", lambda: f"+49 30 23125 {d(3)}", lambda: f"0044 1632 960 {d(3)}", lambda: f"212 555 01{d(2)}" + self.pick([f" ext. {d(2)}", ""]), lambda: f"+331{d(2)} {d(6)}", lambda: f"01632/960{d(3)}",
            lambda: f"1.617.555.0{d(3)}", lambda: f"+1 202-555-0{d(3)}", lambda: f"(303) 555-0{d(3)}", lambda: f"020 7946 0{d(3)}", lambda: f"01 99 00 {d(2)} {d(2)}", lambda: f"415555{d(4)}", lambda: f"415{d(7)}", lambda: d(10), lambda: f"+34 6{d(2)} {d(3)} {d(3)}", lambda: f"0{d(3)} {d(7)}", lambda: f"+{d(2)}{d(9)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(2)}/{d(7)}",
        ])()

    def id_number(self) -> str:
        d, u = self.digits, lambda n: "".join(self.pick("ABCDEFGHKLMNPRSTXZ") for _ in range(n))
        return self.pick([
            lambda: f"{self.pick(['SSN', 'social security number', 'ssn'])} {self.pick(['000', '666'])}{(s := self.pick(['-', ' ']))}{d(2)}{s}{d(4)}", lambda: f"{self.pick(['passport', 'passport no.', 'passport number', 'Passport'])} {u(self.pick([1, 2]))}{d(self.pick([7, 8]))}",
            lambda: f"{self.pick(['Ausweisnummer', 'Personalausweis', 'Ausweisnr.'])} {u(1)}{d(8)}", lambda: f"DNI {d(8)}{u(1)}", lambda: f"{self.pick(['tax ID', 'Steuer-ID', 'Steuernummer', 'tax number'])} {d(3)}/{d(3)}/{d(5)}", lambda: f"{self.pick(['NINO', 'national insurance number'])} {self.pick([f'QQ{d(6)}{u(1)}', f'QQ {d(2)} {d(2)} {d(2)} {u(1)}'])}",
            lambda: f"{self.pick(['identity card number', 'ID card', 'identity number'])} 0000-{d(4)}-{d(4)}", lambda: f"{self.pick(['driving licence', 'driver license', 'driving licence no.'])} {self.pick(['XXXX', u(4)])}{d(7)}", lambda: f"NIE {u(1)}{d(7)}{u(1)}", lambda: f"tax ID {d(11)}",
        ])()

    def address(self) -> str:
        street, city, d, n = (self.invented(1, 2) + self.pick(["bank", "gate", "market", "field", "church", "mill", "park", "hill", "wood", "ford", "", ""])).capitalize(), self.pick([self.invented(2, 3).capitalize(), "Port " + self.invented(1, 2).capitalize(), "New " + self.invented(1, 2).capitalize(), self.invented(2, 2).capitalize() + " " + self.pick(["Falls", "Heights", "Bay", "Springs"])]), self.digits, self.r.randint(1, 240)
        return self.pick([
            lambda: f"{n} {street} {self.pick(['Street', 'Lane', 'Road', 'Drive'])}, {city}", lambda: f"{n} {street} Rd, {city} QQ{d(1)} {d(1)}ZZ", lambda: f"{street}straße {n}, 00{d(3)} {city}", lambda: f"{n}{self.pick([',', ''])} rue des {street}, 00{d(3)} {city}", lambda: f"calle {street} {n}, 2º B, {city}",
            lambda: f"Apt {d(1)}B, {n} North {street} St., {city}", lambda: f"{n}a {street.lower()} avenue, {city}", lambda: f"{n} {street} Street Unit {d(2)} {city}", lambda: f"{street}str. {n}, {d(5)} {city}", lambda: f"Am {street} {n}, {city}", lambda: f"{street}weg {n}", lambda: f"{n} {street} Street\nUnit {d(2)}\n{city}", lambda: f"{n} {street} {self.pick(['Street', 'Lane', 'Avenue'])}",
        ])()

    def neutral(self, template: str) -> str:
        path = lambda: self.pick([f"/{self.invented()}/{self.pick(NOUNS)}/{self.invented()}.{self.pick(['yml', 'py', 'ini', 'log', 'conf', 'json', 'tsv'])}", f"{self.invented()}.{self.pick(['yml', 'py', 'ini', 'log', 'json'])}"])
        fill = {
            "w": lambda: self.pick(NOUNS) if self.r.random() < 0.5 else self.invented(1, 2), "W": lambda: self.pick(ADJECTIVES) if self.r.random() < 0.5 else self.invented(2, 2), "v": lambda: self.pick(VERBS) if self.r.random() < 0.6 else self.invented(1, 2), "P": lambda: self.invented(2, 2).capitalize(), "N": lambda: self.invented(2, 2).capitalize(),
            "n": lambda: self.pick([self.digits(self.r.randint(1, 5)), f"{self.r.randint(1, 20)}.{self.r.randint(0, 30)}"]), "s": lambda: str(self.r.randint(1, 99)), "d": lambda: str(self.r.randint(100, 999999)), "D": lambda: self.digits(8), "r": lambda: self.digits(4), "f": path, "i": self.invented, "u": lambda: f"{self.invented()}{self.r.randint(1, 99)}", "L": lambda: f"{self.pick(COLORS)} {self.pick(THINGS)}", "1": lambda: str(self.r.randint(1, 9)), "4": lambda: self.digits(4),
            "h": lambda: self.pick([f"0x{self.r.randint(0, 1 << 24):X}", f"{self.invented().upper()}-{self.r.randint(1, 9999)}", f"“{self.pick(ADJECTIVES)} {self.pick(NOUNS)}”"]), "x": lambda: f"{self.r.randint(1 << 28, 1 << 32):08x}", "c": lambda: self.pick([f"{self.pick(VERBS)}{self.invented().capitalize()}()", f"{self.invented()}_{self.pick(NOUNS)}", f"--{self.pick(VERBS)}-{self.pick(NOUNS)}", f"{self.invented().capitalize()}.{self.pick(VERBS)}{self.invented().capitalize()}"]),
        }
        return re.sub(r"\{r?(\w)\}", lambda m: fill[m[1]](), template)


def _part(xs: list[str], part: str) -> list[str]:
    return xs if part == "all" else [x for i, x in enumerate(xs) if (i % HELD == HELD - 1) == (part == "held")]


def labelled_table(seed: int = 7, per_kind: int = 320, neutral: int = 1900, part: str = "all") -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) with spans of (start, stop, kind), from all carriers, from those for training or from those held out."""
    m = Maker(seed)
    templates = _part([t for line in NEUTRAL.strip().split("\n") for t in line.split("|")], part)
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    for kind in KINDS:
        carriers = _part(CARRIERS[kind], part)
        weight = 3.2 if kind == "name" else 1
        for k in range(int(per_kind * weight)):
            before, _, after = carriers[k % len(carriers)].partition("{}")
            before, item, after = m.neutral(before), getattr(m, kind)(), m.neutral(after)
            if m.r.random() < 0.35:
                before = m.neutral(m.pick(templates)) + " " + before
            if m.r.random() < 0.35 and after[-1:] in ".?!)":
                after += " " + m.neutral(m.pick(templates))
            bare = item.strip("<>")
            start = len(before) + item.index(bare)
            out.append((before + item + after, [(start, start + len(bare), kind)]))
    for k in range(neutral):
        text = m.neutral(templates[k % len(templates)])
        if m.r.random() < 0.4:
            text += " " + m.neutral(m.pick(templates))
        out.append((text.upper() if m.r.random() < 0.06 else text, []))
    m.r.shuffle(out)
    return out
