"""Training of the personal-data tagger: labelled texts are generated here, the model is fitted in numpy.

    python -m weftline.llm.pii_train weftline/llm/pii.npz

Every text is put together from lines whose personal data are known, lines that only look as if they held some, and
plain lines of work; the spans are known by construction. ``TEXTS`` bounds the sample. Lists, lines and formats were
written from general knowledge of names, addresses, numbers and logs, without a look at any table that the tagger is
measured on. Names are drawn from lists and, for more than as many again, put together from syllables, so that the
tagger reads positions and shapes and not only lists.

Plain language comes from the docstrings of Python's standard library and from random words; data stand in it at any
place, beside labels, and in records of any separator.

Every ``HELD``-th entry of each list of names, streets, towns and lines is held out, and some formats of numbers:
training never draws them, ``scores`` draws nothing else. So its figures are for names and lines the tagger has not seen.
"""

from __future__ import annotations

import importlib
import inspect
import multiprocessing
import os
import random
import re
import sys
import time
from functools import lru_cache

import numpy as np

from weftline.llm.pii import KINDS, TAGS, Tagger, encode_chars

TEXTS, HELD, HELD_FORMATS = 40_000, 10, 17

# Lists of the generator.
FIRST = (
    "James Mary Robert Patricia Michael Jennifer William Linda Thomas Susan Joseph Jessica Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Steven Ashley Andrew Emily Joshua Donna Kenneth Michelle "
    "Kevin Amanda Brian Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Laura Ryan Helen Jacob Amy Gary Angela Nicholas Brenda Eric Nicole Jonathan Samantha Larry Katherine Scott Emma Frank Christine "
    "Stefan Sabine Wolfgang Heike Dieter Ulrike Matthias Birgit Holger Anke Lukas Johanna Moritz Katharina Günther Käthe Jörg Bärbel Pierre Camille Julien Aurélie Antoine Mathilde Thibault Océane Gaël Zoé Étienne Héloïse "
    "Javier Carmen Alejandro Lucía Sergio Pilar Íñigo Begoña Raúl Rocío Álvaro Inés Giovanni Francesca Lorenzo Giulia Davide Elisa Pedro João Fernanda Tiago Larissa Rafael Björn Linnea Gustav Astrid Søren Kirsten Jarkko Aino "
    "Piotr Agnieszka Marek Katarzyna Jakub Tereza Milan Jelena Dragan Ivana Dmitri Olesya Sergei Natalia Andrei Ioana Mehmet Ayşe Hasan Zeynep Omar Layla Khalid Yasmin Ibrahim Amina Rajesh Sunita Arjun Lakshmi Vikram Deepa "
    "Wei Xiulan Jian Mingxia Takeshi Yuko Haruto Sakura Minjun Jiwoo Nguyen Thuy Somchai Siti Kwame Abena Chidi Ngozi Thabo Lerato Tyrone Keisha Sean Niamh Rhys Siân Fiona Hamish"
).split()
LAST = (
    "Johnson Williams Brown Davis Miller Wilson Moore Taylor Anderson Jackson White Harris Thompson Robinson Clark Lewis Walker Hall Allen Young King Wright Hill Scott Green Baker Nelson Carter Mitchell Roberts Turner Phillips "
    "Campbell Parker Evans Edwards Collins Stewart Morris Rogers Reed Morgan Murphy Bailey Cooper Richardson Howard Ward Peterson Gray Ramirez Watson Brooks Sanders Bennett Hughes Foster Hayes Whitfield Ashworth Blackwood Featherstone "
    "Schneider Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Schröder Neumann Zimmermann Krüger Köhler Böhm Größer Bernard Petit Durand Leroy Moreau Lefèvre Mercier Guérin Faure Rousseau Chevalier D'Aubigné "
    "González Rodríguez Fernández López Pérez Sánchez Álvarez Muñoz Ibáñez Ortega Castillo Bianchi Romano Ricci Ferrari Esposito Santos Oliveira Ferreira Gonçalves Carvalho Johansson Lindberg Nyström Åkesson Hansen Kristiansen Virtanen Mäkinen "
    "Nowak Wiśniewski Zieliński Dvořák Svoboda Horvat Petrović Jovanović Ivanov Petrov Volkov Kuznetsova Popescu Ionescu Yılmaz Demir Hassan Khan Rahman Siddiqui Patel Sharma Gupta Reddy Chatterjee Iyer Wang Zhang Chen Huang "
    "Yamamoto Suzuki Kobayashi Watanabe Kim Park Choi Tran Pham Adeyemi Mensah Okonkwo Dlamini O'Connor O'Sullivan McCarthy MacGregor Fitzgerald"
).split() + ["van den Berg", "de Vries", "van der Meer", "de la Fuente", "del Río", "von Bülow", "da Costa", "di Stefano", "Smith-Barnes", "Lund-Olsen", "García-Prieto"]
STREETS = "Maple Cedar Pine Elm Washington Lake Hillcrest Sunset Riverside Highland Orchard Willow Station Victoria Queens Albert Chestnut Meadow Spring Franklin Lincoln Birchwood Foxhollow Stonebridge Whitby Carlisle".split() + ["Martin Luther King", "St. Mary's", "Long Acre", "Old Mill", "Green Park", "Upper Ferry"]
TYPES = "Street Avenue Road Lane Drive Court Way Place Boulevard Terrace Close Crescent Square Walk Row Parkway St. Ave. Rd. Blvd Ct Ln Dr Blvd. Ave St".split()
DE_STREETS = "Hauptstraße Gartenstraße Schulstr. Bergstraße Dorfplatz Kirchweg Rosenallee Waldgasse Ringstr. Mozartstraße Schillerplatz Uferweg Sonnenallee Postgasse Marktplatz Brückenstraße Wiesenweg".split() + ["Am Markt", "An der Mühle", "Unter den Eichen", "Alte Gasse", "Zum Bahnhof", "Berliner Straße", "Kölner Weg"]
ES_STREETS = ["Calle de Alcalá", "Calle San Juan", "Avenida de la Paz", "Avenida Libertad", "Plaza de España", "Paseo del Prado", "Paseo Marítimo", "Camino Viejo", "Ronda de Toledo", "Calle Real", "Plaza del Sol", "Travesía del Mercado"]
FR_STREETS = ["rue de la Paix", "rue des Lilas", "avenue de la République", "boulevard Saint-Michel", "place du Marché", "impasse du Moulin", "chemin des Vignes", "allée des Chênes", "quai de la Tour", "rue du Château", "avenue Jean Jaurès", "route de Lyon"]
TOWNS = "Boston Chicago Denver Austin Portland Leeds Bristol York Dublin Cork Berlin Hamburg München Köln Leipzig Lyon Nantes Toulouse Madrid Sevilla Bilbao Oakville Westbrook Fairview Millford Ashbourne Lakeside Kirkham Altenburg Grünwald Beaulieu Montclair Puebla Riofrío".split() + ["New York", "San Diego", "Salt Lake City", "Stoke-on-Trent", "Bad Homburg", "Saint-Denis", "Las Palmas", "Port Harbour"]
HOSTS = "example.com example.net example.org mail.example.org test.example acme.test corp.example gmail.com outlook.com yahoo.co.uk web.de orange.fr correo.es company.io university.edu startup.dev post.invalid inbox.test uni.example.ac.uk".split()
WORDS = "account adapter archive asset backup batch bridge bucket builder bundle button catalog channel checkout client cluster command config console context cursor dashboard database deploy device driver engine event feature fetch field file folder form gateway graph group handler header helper image input invoice item job label layer ledger library line list lock logger mapper menu message metric model module monitor node notice object option order packet page panel payload pipeline pool profile project proxy query reader record region release request resource result rule runner sample scanner schedule script section selector server service shape signal snapshot socket source stage storage stream style table tag target task template theme thread timer topic trace trigger type user value vector version view widget window wizard writer".split()
EXT = "ts tsx js py go rs java rb sql md json yml css".split()
TITLES = "Mr Mrs Ms Dr Prof. Dr. Mr. Mrs. Herr Frau Monsieur Madame M. Mme Señor Señora Sr. Sra.".split()

# Lines with slots. {N} full name in any form, {F} first name, {L} last name, {T} title, {E} e-mail, {P} phone, {I} id number, {A} address; {p} path, {w} word, {n} number, {h} hex, {d} date.
CASES = [
    "{E}", "{P}", "{N}", "{A}", "write to {E}", "Reach us at {E} or {P}.", "E-mail: {E}", "email={E}", "<{E}>", '"email": "{E}"', "mailto:{E}?subject=hello", "from {E} to {E}", "Sent by {E} on {d}", "{w} failed for user {E}", "login {E} ok", "invite {E} to the {w}", "the account {E} is locked again, please unlock it",
    "SELECT * FROM users WHERE email = '{E}'", "INSERT INTO people (name, email) VALUES ('{N}', '{E}');", "UPDATE contact SET phone = '{P}' WHERE email = '{E}';", "{n};{N};{E};{P}", "{n},{N},{E}", "name,phone,id\n{N},{P},{I}\n{N},{P},{I}", "{E},{I}\n{E},{I}", "{N}\t{E}\t{P}", "| {N} | {E} |", "| {n} | {N} | {P} | {A} |", "- {N}: {P}", "* {N} ({E})",
    "Author: {N} <{E}>\nDate: {d}", "Committer: {N} <{E}>", "Signed-off-by: {N} <{E}>", "Co-developed-by: {N} <{E}>", "commit {h}\nAuthor: {N} <{E}>\n\n    {w}: fix the {w}", "{h} {N} {d} update {w}", "{h} ({N} {d} {n}) const {w} = {n}", "Reviewer: {N}", "Reported-by: {N}", "Approved by {N}", "owner: {N}", "assigned to {N}", "Assignee: {N}\nStatus: open", "contact_name: {N}", "maintainer = \"{N}\"", "@author {N}", "// TODO({F}): clean this up", "Ticket opened by {N}: the {w} is slow",
    "To: {N} <{E}>\nFrom: {N} <{E}>\nSubject: {w} {w}", "Cc: {E}, {E}", "Dear {N},", "Dear {T} {L},", "Hello {F},", "Hi {F} - could you look at the {w}?", "Best,\n{F}", "Sincerely,\n{N}\n{P}", "Kind regards, {N}", "Thanks {F}!", "cheers, {F}", "-- \n{N}\n{E}\n{P}", "thx {F}, works now", "{F}: can you restart the {w}?", "@{F} please have a look", "pinging {F} and {F} about this", "as {F} said, the {w} has to go", "{F} told me that the {w} is done", "spoke with {N} today", "{N} wants the {w} by Friday", "{N} and {N} both use the {w}.", "{F} broke the {w}, {F} fixed it.", "I asked {T} {L} for the {w}.", "{T} {N} runs the {w} team.", "{T} {L} will call back.", "according to {N}, nothing changed", "{L} approved it", "{L} maintains the {w}.", "{N} is on leave", "for {N} only",
    '{{"name": "{N}", "phone": "{P}"}}', '{{"firstName": "{F}", "lastName": "{L}", "email": "{E}"}}', '{{"user": {{"full_name": "{N}", "ssn": "{I}", "address": "{A}"}}}}', "name: {N}\nphone: {P}\naddress: {A}", "first_name={F}&last_name={L}&tel={P}", "<name>{N}</name><tel>{P}</tel>", "<li>{N}, {A}</li>", "<td>{E}</td><td>{P}</td>", "BEGIN:VCARD\nN:{N}\nEMAIL:{E}\nTEL;TYPE=cell:{P}\nADR:{A}\nEND:VCARD", "user \"{N}\" ({E}) signed in", "audit: user={N} phone={P} action=login", "DEBUG {w} payload: {N} / {I}", "ERROR could not bill {N} at {A}", "WARN invalid number {P} for {N}", "KeyError: '{E}'", "duplicate key ({E}) in {w}", "Error: no such customer {I}", "row {n}: {I} {E}", "national_id: {I}", "id_number={I} status=ok", "passport no. {I}", "Passport {I} of {N} expires {d}", "Social security number: {I}", "her SSN is {I}", "tax id {I}", "identity card {I}", "ID {I} belongs to {N}.", "the applicant ({I}) asked again", "insured person {I}, {N}", "holder {N}, document {I}", "why does the form reject {I}?", "{I}, {P}", "{I} / {E}", "personal number {I} is taken",
    "call {P}", "Tel: {P}", "tel:{P}", "phone={P}", "Phone {P}, fax {P}", "Mobile: {P}", "his cell is {P}", "you can reach me under {P} until six", "number {P} does not ring", "dial {P} for support", "sms to {P} failed", "{N}, {P}", "{N} - {P}", "{N} at {P}", "ring {N} on {P} first", "{P} ({N})", "urgent: {P}", "to={P} from={P}", "WhatsApp {P}",
    "Address: {A}", "address={A}", "ship to {A}", "Ship to:\n{N}\n{A}", "Deliver it to {N}, {A}.", "lives at {A}", "The new office of {N} is at {A}.", "{N} moved from {A} to {A}.", "billing address: {A}, phone: {P}", "home address {A} is wrong in the {w}", "the pickup point at {A} is closed", "geocoder returns nothing for {A}", "send the parcel to {A} please", "{A} is not in our area", "our warehouse:\n{A}\n{P}", "From: {A}\nTo: {A}", "meet me at {A} tomorrow", "Invoice for {N}\n{A}\n{E}", "customer {N} of {A} complained about the {w}", "visitor {N} ({I}), {A}, {P}",
    "Frau {L} hat angerufen, Rückruf unter {P}.", "Herr {L} wohnt in der {A}.", "Anschrift: {A}", "Name: {N}, Telefon: {P}", "Bitte {F} fragen.", "Die Mail an {E} kam zurück.", "Kundin {N}, {A}", "Ausweisnummer {I} von {N}", "Mit freundlichen Grüßen\n{N}", "Liebe {F},", "{N} hat das geprüft.", "Rufnummer {P} ist falsch",
    "Bonjour {F},", "Monsieur {L} habite au {A}.", "Madame {L} a appelé, son numéro est le {P}.", "Écrivez à {E}.", "Adresse postale : {A}", "Le client {N} ({I}) attend.", "Cordialement,\n{N}", "Téléphone : {P}", "Courriel : {E}", "{N} a relu la page.", "appeler {F} au {P}",
    "Hola {F},", "La señora {L} vive en {A}.", "El teléfono de {N} es {P}.", "Correo: {E}", "Dirección: {A}", "Documento {I} a nombre de {N}", "Saludos,\n{N}", "Escribe a {E} cuando acabes.", "la clienta {N} llama desde {P}", "{N} lo revisó ayer", "pregunta a {F}",
    "ok, I put {E} on the list", "please remove {N} from the {w}, address {A}", "use {E} with phone {P} for the test account", "the failing record: {N}, {I}, {P}", "found {N} <{E}> in {p}", "{p}:{n}: {N} <{E}>", "{p}: contact {E}", "seed data: {F} {L}, {E}", "user {n} = {F}", "expected '{N}' but got '{N}'", "{w}.{w} = '{E}'", "hint: {N} changed {p} on {d}", "Participants: {N}, {N}, {N}", "Attendees: {F}, {F} and {F}", "on-call this week: {N} ({P})", "escalation contact {N}, {E}, {P}", "-> {N}", "# {N}", "({N})", "[{N}]", "\"{N}\"", "{N};", "{N}:", "~{F}", "{N} ({d}): I do not agree.", "{F} {d}: the {w} is back",
]
NEAR = [
    "git@git.host.test:{w}/{w}.git", "origin  git@code.test:{w}/{w}.git (fetch)", "ssh://git@{w}.test:22/{w}.git", "https://{w}.test/{w}/{w}.git", "git clone https://user@{w}.test/{w}.git", "@{w}/{w}@{n}.{n}.{n}", "npm install @{w}/{w}@{n}.0.0", "{w}@{n}.{n}.{n}", "{w}@{h}", "docker pull {w}/{w}@sha256:{h}{h}{h}{h}", "@Override", "@app.route('/{w}')", "@pytest.mark.{w}", "@media (min-width: {n}px)", "def {w}(self, @{w})", "root@{w}:~# ls", "{w}@{w}:~$ make", "user@host is the default of the {w}",
    "{n}.{n}.{n}.{n}", "10.{n}.{n}.{n}:8080", "listening on 127.0.0.1:{n}{n}", "host {w}.{w}.test:443", "v{n}.{n}.{n}", "version {n}.{n}.{n}-beta.{n}", "Python 3.{n}.{n}", "build {n}{n}-{n}{n}", "sha1 {h}{h}{h}{h}{h}", "commit {h}{h}{h}{h}{h}", "uuid {h}-{n}{n}-4{n}a-8{n}b-{h}{h}", "{h}-{n}{n}-4{n}c-9{n}d-{h}{h}", "id={h}{h}", "request id {n}{n}{n}-{n}{n}", "trace {n}{n}{n}{n}{n}{n}", "run {n}{n}{n}{n}{n}", "job {n}{n}-{n}{n}-{n}{n} finished", "order no. {n}{n}{n}-{n}", "invoice {d}-{n}{n}", "ISBN 978-{n}-{n}{n}-{n}{n}-1", "ticket {n}{n}-{n}{n}{n}", "case {n}{n}/{n}{n}", "account 00{n}{n}{n} is a placeholder", "epoch 17{n}{n}{n}{n}", "ts={n}{n}{n}{n}{n}.{n}{n}", "{d}T{n}:{n}:00Z {w} started", "{d} {n}:{n}:{n},{n}{n} INFO {w}", "took {n}.{n}{n} s, {n}{n} MB", "{n}{n}-{n}{n} of {n}{n}{n} rows", "range {n}{n}..{n}{n}{n}", "pages {n}{n}-{n}{n}", "{n}{n}{n}-{n}{n}{n}-{n}{n}{n}{n} is not a valid key", "0x{h}{h}", "#{h}", "rgb({n}, {n}, {n})", "lat {n}.{n}{n}{n}, lon -{n}.{n}{n}{n}", "bench: {n}{n}{n}.{n} ops/s", "port {n}{n} is in use", "{n} passed, {n} failed", "{n} files changed, {n}{n} insertions(+), {n} deletions(-)", "HTTP 404 for /{w}/{n}{n}", "size {n}{n}{n}x{n}{n}{n}", "+{n}{n} -{n}{n}", "total {n}{n}\ndrwxr-xr-x {n} dev dev 4096 {w}", "-rw-r--r-- 1 dev dev {n}{n} {p}", "{n}% of {n}{n}{n}{n}", "USD {n},{n}{n}{n}.{n}", "IBAN field is empty", "the phone field is empty", "no e-mail given", "missing ssn", "the address is optional", "name is required", "id card not provided", "SSN column dropped", "passport field hidden",
    "Visual Studio Code", "Google Chrome and Apple Safari", "Amazon Web Services", "Apache Spark runs on Hadoop", "Microsoft Office", "Red Hat Linux", "Internet Explorer", "Ruby on Rails", "Spring Boot, Next Step", "Windows Server {n}{n}", "Jenkins and Travis build it", "Julia and Ada are languages", "the Lucy theme", "Release Notes", "Getting Started", "Known Issues", "Table Of Contents", "Pull Request #{n}", "Open Source", "Quick Start, Next Steps", "Terms Of Service", "Main Menu, Side Bar", "North America, South East Asia", "Monday, Tuesday", "January {n}, {n}{n}", "Hello World", "Lorem Ipsum", "Merge Branch", "class {F}{L}Service:", "class {F} extends {L}Base", "new {L}Factory()", "import {F} from './{w}'", "struct {L} {{", "interface {F}Props", "enum {L}Type", "the {F} theme and the {F} font", "the {L} algorithm", "{L}'s law is not used here", "package {F} is deprecated", "module {L} loaded", "codename {F} ships with the {w}", "{F}.js and {L}.py", "release \"{F}\" of the {w} library", "the {F} plugin", "server {F} is down", "cluster {L} restarted", "function {F}() {{}}", "{L}Exception in thread \"main\"", "Step {n}, Lane {n}", "Court of Appeal", "Street view is off", "Road map {n}{n}", "{n} Main Threads", "Avenue for later work", "Drive D: is full", "Place {n} items in the {w}", "the Way {n} modules load", "Row {n}, Column {n}", "Lane {n} is blocked", "{n} Square pixels", "Close {n} Issues", "Walk {n} Nodes", "Terrace view widget", "Parkway module v{n}", "the Church encoding", "{n} Open Tasks, {n} Done", "Worker {n}, Thread {n}", "Room {n}{n}, Floor {n}", "Chapter {n}, Page {n}{n}",
]
PLAIN = [
    "no output", "ok", "Done.", "yes", "continue please", "The {w} works again.", "I read {p} and changed the {w}.", "Let me look at {p} first.", "Now I run the tests.", "All tests pass.", "The build is red because of the {w}.", "Could you add a {w} to the {w}?", "Fix the {w} in {p}.", "What does {p} do?", "Why is the {w} slow?", "Please rename {w} to {w}.", "Rename the {w}, then push.", "I will add a check for the {w}.", "The {w} reads the {w} twice.", "const {w} = {w}({n});", "return {w}.{w}({w});", "if ({w} > {n}) return null;", "def {w}({w}): return {n}", "SELECT count(*) FROM {w}", "{p}", "{p}:{n}:{n}", "{p}\n{p}\n{p}", "Error: cannot open {p}", "TypeError: {w} is not a function\n    at {w} ({p}:{n}:{n})", "FAIL {p}", "PASS {p}", "warning: unused variable {w}", "fatal: not a git repository", "Permission denied", "command not found: {w}", "timeout after {n} s", "Updated {n} files", "Found {n} matches", "nothing to commit, working tree clean", "Switched to branch '{w}-{w}'", "On branch {w}", "[{w} {h}] {w} {w}", "* {h} change {w}", "diff --git a/{p} b/{p}", "status: pending", "waiting for the {w}", "retry {n} of {n}", "query returned {n} rows", "See {p} for the rest.", "# {w}\n\n- {w}\n- {w}", "1. read {p}\n2. change the {w}\n3. run the {w}", "The plan: first the {w}, then the {w}.", "Die Prüfung läuft noch.", "Der {w} ist fertig.", "Le {w} est prêt.", "La prueba falla.", "Il manque une ligne.", "falta un campo", "bitte weiter", "oui, merci", "sí, sigue", "I changed my mind about the {w}.", "Not sure whether the {w} is needed.", "It turns out the {w} is unused.", "The user wants a {w}.", "Nobody uses the {w}.", "Every {w} has a {w}.", "Open question: is the {w} needed?", "user: go on", "assistant: done", "Stop here.", "Looks good to me.", "Undo the last change.", "Deploy the {w} to staging.", "Opened a pull request.", "See #{n}.", "closes #{n}{n}", "npm run {w}", "make {w}", "git push origin {w}", "kubectl get pods -n {w}", "curl -s localhost:{n}{n}/{w}", "docker logs --tail {n} {w}", "", "", "\t", "---",
]

# Labels of fields, in four languages, by what they stand before.
LABELS = {
    "N": "name; full name; customer; client; contact; owner; author; user; FN; Name; Nom; Nombre; Kunde; Client; Cliente; Titular; Ansprechpartner; to; from; attn; c/o; signed; by; reviewer; requested by; patient; employee".split("; "),
    "E": "email; e-mail; mail; E-Mail; Email; Mail; courriel; correo; EMAIL; login; user; to; cc; bcc; reply-to; from; contact".split("; "),
    "P": "tel; Tel; Tel.; TEL; phone; Phone; phone no.; mobile; Mobile; cell; fax; Fax; Telefon; Handy; Mobil; Téléphone; tél.; Teléfono; Móvil; call; Rückruf; desk phone; hotline; whatsapp; sms".split("; "),
    "I": "id; ID; SSN; ssn; tax id; TIN; ITIN; passport; Passport; Pass; NIN; NI number; DNI; NIE; NIF; INSEE; NIR; Steuer-ID; Ausweis; CPF; national id; national_id; identity number; id card; document; document no; personal no.; person id; insurance number".split("; "),
    "A": "address; Address; ADR; addr; street; Adresse; Anschrift; Dirección; domicilio; home; ship to; shipping; billing address; lives at; delivery; site; office; venue; location; drop-off".split("; "),
}
_MODULES = "argparse asyncio calendar collections configparser contextlib csv datetime decimal difflib doctest email.message fractions ftplib functools gettext glob gzip heapq html http.client http.server imaplib inspect io ipaddress itertools json logging mailbox mimetypes multiprocessing optparse os pathlib pdb pickle platform plistlib pprint queue random re sched selectors shelve shlex shutil smtplib socket sqlite3 ssl statistics string subprocess tarfile tempfile textwrap threading timeit tokenize traceback types typing unittest urllib.request uuid venv warnings wave weakref webbrowser xml.etree.ElementTree zipfile".split()
# Everyday words of three more languages.
OTHER_WORDS = (
    "der die das und ist nicht mit von auf für eine einen dem den sich auch wird noch nach bei aus wenn kann hat sind wir sie ich bitte heute morgen wieder schon immer fehler datei prüfung änderung antwort frage liste seite zeile kunde wohnt telefon unter "
    "le la les des est pas avec pour une dans sur qui que plus par elle nous vous encore toujours demain fichier erreur page ligne liste réponse question client habite au téléphone appelez merci changement essai "
    "el los las es no con para una en que por más se su como pero ya todavía mañana archivo error página línea lista respuesta pregunta cliente vive teléfono llama gracias cambio prueba sigue"
).split()


@lru_cache(1)
def doc_lines() -> tuple[str, ...]:
    """Lines of the docstrings of the standard library, without those that may name someone."""
    out = set()
    for name in _MODULES:
        try:
            module = importlib.import_module(name)
        except ImportError:
            continue
        for thing in [module, *[v for _, v in inspect.getmembers(module) if inspect.isclass(v) or inspect.isroutine(v)]]:
            for line in (inspect.getdoc(thing) or "").split("\n"):
                if 15 < len(line.strip()) < 140 and not re.search(r"@|[Aa]uthor|opyright|written by|[Cc]ontribut|Rossum|Peters|Hettinger|Lundh|[0-9]{4,}", line):
                    out.add(line.strip())
    return tuple(sorted(out))


_SYL = "al an ar bel ber bran cal cas cor dan del der dor el en er fal fen gar gal gor hal har hel ith jan kal kar kel lan len lin lor mar mel mir mor nal nar nel nor ol or pal per quin ral ran rel ros sal sel sor tal tar tel tor ul val var vel ver vin wal wen yor zan zel ba be bi bo da de di do fa fe ga ge ha he hi ka ki ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va vo wa wo ya yo za zu".split()
_ENDS = "son sen ski ska ova ov ev ic ić ez es o a i er mann stein berg burg feld wald thal hof ström qvist gren lund dahl vik by ton ham ley field ford worth wood well combe more mont ard eau aux ot elli etti ini ano escu oglu yan wala uchi moto naka shi suwa dori".split()
_FEMALE = "a ia na ra la ina ette elle ine e ya ika".split()


def _part(items: list, held: bool | None, every: int = HELD) -> list:
    """The entries that training draws, or those that are held out; all for None."""
    return items if held is None else [x for i, x in enumerate(items) if (i % every == every - 1) == held]


class Generator:
    """Texts with spans (start, stop, kind); everything drawn from one seeded generator. ``held`` draws from what training never sees, None from all."""

    def __init__(self, seed: int, held: bool | None = False):
        self.r = random.Random(seed)
        part = lambda items: _part(items, held)
        self.firsts, self.lasts, self.streets, self.de, self.es, self.fr = part(FIRST), part(LAST), part(STREETS), part(DE_STREETS), part(ES_STREETS), part(FR_STREETS)
        self.types, self.towns, self.hosts, self.titles = TYPES, part(TOWNS), part(HOSTS), TITLES
        self.cases, self.near, self.plain = part(CASES), part(NEAR), part(PLAIN)
        self.held = held
        few = lambda items: _part(items, held, HELD_FORMATS)
        self.phones, self.ids = few(self._phones()), few(self._ids())
        self.docs = part(list(doc_lines()))
        self.make = {"N": ("name", self.name), "F": ("name", self.first), "L": ("name", self.last), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("id_number", self.ident), "A": ("address", self.address)}

    def _made(self, end: list[str], least: int = 1, most: int = 2) -> str:
        return ("".join(self.r.choice(_SYL) for _ in range(self.r.randint(least, most))) + self.r.choice(end)).capitalize()

    def first(self) -> str:
        return self.r.choice(self.firsts) if self.r.random() < 0.6 else self._made(_FEMALE + ["n", "s", "o", "us", "or", "im"])

    def last(self) -> str:
        x = self.r.random()
        if x < 0.45:
            return self.r.choice(self.lasts)
        made = self._made(_ENDS)
        if x > 0.94:
            return made + "-" + self._made(_ENDS)
        return self.r.choice(["O'", "Mc", "D'", "van ", "de ", "von ", "van der ", "de la "]) + made if x > 0.88 else made

    def _case(self, s: str) -> str:
        x = self.r.random()
        return s.upper() if x < 0.08 else s.lower() if x < 0.15 else s

    def name(self) -> str:
        f, last, x = self.first(), self.last(), self.r.random()
        initial = self.r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ")
        if x < 0.50:
            n = f"{f} {last}"
        elif x < 0.60:
            n = f"{f} {initial}. {last}"
        elif x < 0.68:
            n = f"{f[0]}. {last}"
        elif x < 0.81:
            n = f"{last}, {f}"
        elif x < 0.84:
            n = f"{last}, {f[0]}."
        elif x < 0.87:
            n = f"{f} {initial}."
        elif x < 0.90:
            n = f"{f} {self.first()} {last}"
        elif x < 0.95:
            n = last
        else:
            n = f
        return n if "." in n else self._case(n)

    def email(self) -> str:
        r = self.r
        plain = lambda s: "".join(c for c in s.lower().translate(str.maketrans("éèüößøúñåçãáíóäğışıěščřžýćłńśź", "eeuosounacaaioagisiescrzyclnsz")) if c.isascii() and c.isalpha()) or "x"
        f, last, n = plain(self.first()), plain(self.last()), r.randint(1, 2009)
        local = r.choice([f"{f}.{last}", f"{f}.{last}", f"{f}_{last}", f"{f}-{last}{n % 100}", f"{f}{last}", f"{f[:1]}{last}", f"{f[:1]}.{last}", f"{last}.{f}", f"{last}.{f[:1]}", f"{f}{n}", f"{f}+{r.choice(WORDS)}", f"{f}_{last}{n % 100}", f"{last}{n % 1000}", f"{f}.{last}+{r.choice(WORDS)}"])
        host = r.choice(self.hosts) if r.random() < 0.75 else f"{r.choice(WORDS)}.{r.choice(['com', 'org', 'example', 'net', 'test', 'de', 'co.uk', 'example.com'])}"
        x = r.random()
        if x < 0.62:
            e = f"{local}@{host}"
            return e.upper() if r.random() < 0.1 else e
        if x < 0.70:
            return f"{local}[at]{host}"
        if x < 0.80:
            return f"{local} (at) {host.replace('.', ' (dot) ')}" if r.random() < 0.7 else f"{local}(at){host}"
        return f"{local} @ {host}" if x < 0.90 else f"{local}%40{host}"

    def _digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def _letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))

    def _phones(self) -> list:
        """Formats of telephone numbers: # is a digit, 9 one of 1-9."""
        return [
            "9##-###-####", "(9##) ###-####", "9##.###.####", "+1 9##-###-####", "+1 (9##) ###-####", "+1-9##-###-####", "+19#########", "9## ### ####", "1-9##-###-####", "9##-###-#### ext. ##", "9##-###-#### x###", "(9##) ###-#### ext ###", "+1 9## ### ####", "###-####-9## #", "+44 7### ######",
            "07### ######", "+44 20 #### ####", "020 #### ####", "01### ######", "+44 (0)1## ### ####", "07### ### ###", "+49 9## ######", "+49 9# ########", "+49 (0)9## #####-##", "0##/#######", "0### ######", "0### #####-###", "0##/##### ###", "+49 9# #####-###", "+33 6 ## ## ## ##", "06 ## ## ## ##", "01.##.##.##.##", "+33 1 ## ## ## ##",
            "06-##-##-##-##", "+336########", "+34 6## ### ###", "6## ## ## ##", "+34 9## ## ## ##", "9## ### ###", "+39 3## ### ####", "+31 6 ########", "+41 7# ### ## ##", "+48 ### ### ###", "+91 9#### #####", "+61 4## ### ###", "+353 8# ### ####", "+9# ### ### ####", "+9## ## ### ####", "00## ### #######", "0049 9## #######", "+9#-###-#######", "+1 9## 555 0###",
        ]

    def _ids(self) -> list:
        """Formats of identity, tax and passport numbers: # is a digit, @ a letter."""
        return [
            "###-##-####", "###-##-####", "### ## ####", "9##-##-####", "@@ ## ## ## @", "@@######@", "@@######@", "@@ ###### @", "########@", "########-@", "##.###.###-@", "##.###.###@", "@#######@", "@-#######-@", "## ### ### ###", "###########", "## ## ## ### ### ##", "# ## ## ## ### ### ##", "#############", "@########", "@@#######", "@@#######",
            "##@@#####", "@#@##@##@", "@@@######", "######-####", "########-####", "###.###.###-##", "##-#######", "@### ### ###", "####-####-####", "@@@@@#####@", "######/####", "#### #### ####", "@@-###-###",
        ]

    def _fill(self, form: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "#" else self.r.choice("123456789") if c == "9" else self._letters(1) if c == "@" else c for c in form)

    def phone(self) -> str:
        return self._fill(self.r.choice(self.phones))

    def ident(self) -> str:
        s = self._fill(self.r.choice(self.ids))
        return "".join("0" if c.isdigit() and self.r.random() < 0.5 else c for c in s[: len(s) // 2]) + s[len(s) // 2 :] if self.r.random() < 0.12 else s

    def address(self) -> str:
        r, n = self.r, self.r.choice([self.r.randint(1, 99), self.r.randint(1, 400), self.r.randint(100, 9999)])
        town = r.choice(self.towns) if r.random() < 0.6 else self._made("haven stadt ville mere bridge mouth burg fels ford ia ona sol wick port dale".split())
        town = r.choice(["Port ", "San ", "Bad ", "New ", "St. "]) + town if r.random() < 0.06 else town
        zip_, x = r.choice([f"{r.randint(10000, 99999)}", f"0{self._digits(4)}"]), r.random()
        uk = f"{self._letters(r.randint(1, 2))}{r.randint(1, 20)} {r.randint(1, 9)}{self._letters(2)}"
        if x < 0.50:
            base = r.choice(self.streets) if r.random() < 0.55 else self._made("wood field mere ton stone gate hurst dale berry bank moor marsh man's glove".split())
            base = f"{r.choice(['Old', 'New', 'North', 'Upper', 'West', 'Copper', 'Stone'])} {base}" if r.random() < 0.12 else base
            street = f"{n}{r.choice(['', '', '', 'a', 'B'])} {base} {r.choice(self.types)}"
            flat = r.choice([f"Apt {r.randint(1, 60)}", f"Apt. {r.randint(1, 60)}", f"Suite {r.randint(1, 900)}", f"Unit {r.randint(1, 30)}", f"#{r.randint(1, 90)}"])
            front = r.choice([f"Flat {r.randint(1, 40)}", f"Apartment {r.randint(1, 40)}", f"Unit {r.randint(1, 40)}"])
            a = r.choice([street, street, street, f"{street}, {town}", f"{street}, {town} {zip_}", f"{street}, {town} {zip_}", f"{street}, {flat}, {town} {zip_}", f"{street} {flat}, {town}", f"{front}, {street}, {town}", f"{street}\n{town} {zip_}", f"{street}, {town}, {uk}", f"{street}, {town} {uk}", f"{street}, {flat}", f"{front}, {street}", f"{street},\n{town} {zip_}", f"{street}, {town}, {r.choice(['CA', 'NY', 'TX', 'WA'])} {zip_}"])
        elif x < 0.74:
            s = r.choice(self.de) if r.random() < 0.6 else self._made("straße weg gasse platz allee str. hang ufer".split())
            s = f"{s} {n % 200 + 1}{r.choice(['', '', 'a', 'b', 'c'])}"
            a = r.choice([s, f"{s}, {zip_} {town}", f"{s}, {zip_} {town}", f"{s}\n{zip_} {town}", f"{s}, {town}"])
        elif x < 0.87:
            s = r.choice(self.es) if r.random() < 0.6 else f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Paseo'])} {r.choice(['de la', 'del', 'de los', 'de las', ''])} {self._made(['a', 'o', 'al', 'ar', 'illo', 'era', 'os', 'ina'])}".replace("  ", " ")
            a = r.choice([f"{s}, {n % 300 + 1}, {zip_} {town}", f"{s} {n % 300 + 1}, {zip_} {town}", f"{s}, {n % 300 + 1}", f"{s}, {n % 300 + 1}\n{zip_} {town}"])
        else:
            s = r.choice(self.fr) if r.random() < 0.6 else f"{r.choice(['rue', 'avenue', 'boulevard', 'impasse', 'chemin', 'place'])} {r.choice(['de la', 'du', 'des', 'de'])} {self._made(['ière', 'eaux', 'ard', 'ette', 'iers', 'oise', 'uls', 'ins'])}"
            a = r.choice([f"{n % 300 + 1}, {s}, {zip_} {town}", f"{n % 300 + 1} {s}, {zip_} {town}", f"{n % 300 + 1}, {s}", f"{n % 300 + 1} {s}\n{zip_} {town}", f"{n % 300 + 1} bis, {s}, {zip_} {town}"])
        x = r.random()
        return a.lower() if x < 0.10 else a.upper() if x < 0.14 else a

    def line(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        out, spans, i = "", [], 0
        make = self.make
        fill = {
            "p": lambda: "/".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) + f"/{r.choice(WORDS)}.{r.choice(EXT)}", "w": lambda: r.choice(WORDS), "n": lambda: str(r.randint(1, 99)), "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 8]))),
            "d": lambda: f"20{r.randint(18, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "T": lambda: r.choice(self.titles),
        }
        near = template in _NEAR
        while i < len(template):
            if template[i : i + 2] in ("{{", "}}"):
                out, i = out + template[i], i + 2
            elif template[i] == "{" and template[i + 2 : i + 3] == "}":
                k = template[i + 1]
                if k in make:
                    kind, f = make[k]
                    value = f()
                    if not near:
                        spans.append((len(out), len(out) + len(value), kind))
                else:
                    value = fill[k]()
                out, i = out + value, i + 3
            else:
                out, i = out + template[i], i + 1
        return out, spans

    def sentence(self) -> str:
        """Plain language: a docstring's line, or random words."""
        r, x = self.r, self.r.random()
        if x < 0.6:
            return r.choice(self.docs)
        words = [r.choice(OTHER_WORDS if x < 0.8 else WORDS) for _ in range(r.randint(2, 9))]
        if r.random() < 0.5:
            words[0] = words[0].capitalize()
        if r.random() < 0.2:
            words = [w.capitalize() for w in words[:4]]
        return " ".join(words) + r.choice([".", ".", "", "!", "?", ":", "..."])

    def noted(self) -> str:
        """A sentence behind a mark: a level, a speaker, a number, an error's name."""
        r = self.r
        mark = r.choice(["Error: ", "error: ", "TypeError: ", "ValueError: ", "Warning: ", "fatal: ", "Note: ", "FAIL ", "INFO ", "WARN ", "user: ", "assistant: ", "- ", "* ", "> ", "# ", "## ", "TODO: ", "PR: ", f"{r.randint(1, 99)}. ", f"[{r.choice(WORDS)}] ", f"({r.randint(1, 99)}) ", f"[{r.choice(WORDS)} {r.randint(0, 16**7):x}] ", f"{r.choice(WORDS)}: ", f"{r.randint(1, 99)} ", f"Row {r.randint(1, 99)}, ", "Closes: "])
        s = self.sentence()
        return mark + (s[:1].upper() + s[1:] if r.random() < 0.6 else s)

    def _pieces(self, parts: list) -> tuple[str, list[tuple[int, int, str]]]:
        """Text and spans of parts that are plain text or (kind, value)."""
        out, spans = "", []
        for x in parts:
            if isinstance(x, tuple):
                spans.append((len(out), len(out) + len(x[1]), x[0]))
                x = x[1]
            out += x
        return out, spans

    def _value(self, k: str) -> tuple[str, str]:
        kind, f = self.make[k]
        return kind, f()

    def labelled(self) -> tuple[str, list[tuple[int, int, str]]]:
        """Fields with labels, one after the other."""
        r = self.r
        parts, sep, end = [], r.choice([": ", ": ", ":", "=", " ", "\t", " = ", '="', " is "]), r.choice(["\n", "; ", ", ", " ", " | ", " - "])
        for i in range(r.choice([1, 1, 2, 3, 4])):
            k = r.choice("NEPIA")
            label = r.choice(LABELS[k])
            label = r.choice(["", "", "contact.", "user_", "customer "]) + label if r.random() < 0.2 else label
            parts += [end if i else "", label.upper() if r.random() < 0.06 else label, sep, self._value(k), '"' if sep == '="' else ""]
            if r.random() < 0.15:
                parts += [end, r.choice(WORDS), sep.rstrip('"'), r.choice(["n/a", "withheld", "-", "yes", "none", str(r.randint(1, 9999))])]
        return self._pieces(parts)

    def record(self) -> tuple[str, list[tuple[int, int, str]]]:
        """Rows of a table with any separator, some plain columns between."""
        r = self.r
        sep, cols, parts = r.choice([";", ";", ",", ",", "\t", "|", " | ", ", ", "</td><td>", "', '", '","', " / "]), [r.choice("NEPIANEPIw") for _ in range(r.randint(2, 5))], []
        opener, closer = {"</td><td>": ("<td>", "</td>"), "', '": ("('", "')"), '","': ('"', '"'), " | ": ("| ", " |")}.get(sep, ("", ""))
        for row in range(r.randint(1, 3)):
            parts += ["\n" if row else "", opener]
            for i, k in enumerate(cols):
                parts += [sep if i else "", r.choice(WORDS + [str(r.randint(1, 500))]) if k == "w" else self._value(k)]
            parts.append(closer)
        return self._pieces(parts)

    def carried(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A datum or more at any place of a plain sentence."""
        r = self.r
        words, parts = self.sentence().split(" "), []
        at = {r.randint(0, len(words)) for _ in range(r.choice([1, 1, 2]))}
        for i in range(len(words) + 1):
            if i in at:
                k = r.choice("NNNFLEPIAA")
                a, b = r.choice([("", ""), ("", ""), ("", ""), ("", ","), ("(", ")"), ("'", "'"), ('"', '"'), ("<", ">"), ("[", "]"), ("", "."), ("", ":"), ("@", "") if k == "F" else ("", "?"), *[(r.choice(self.titles) + " ", r.choice(["", ",", "."])) if k in "NL" else ("", "!")] * (6 if k == "L" else 2), *[(r.choice(["Hi ", "Thanks, ", "thanks ", "Hey ", "Hello ", "with ", "by ", "ask ", "and ", "or ", "for ", "von ", "an ", "de ", "à ", "à ", "a "]), "")] * (4 if k in "NFL" else 0), (r.choice(LABELS[k if k in LABELS else "N"]) + " ", "")])
                parts += [a, self._value(k), b, " " if i < len(words) else ""]
            if i < len(words):
                parts.append(words[i] + (" " if i < len(words) - 1 or len(words) in at else ""))
        return self._pieces(parts)

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        out, spans = "", []
        for k in range(r.choice([1, 1, 2, 2, 2, 3, 3, 4])):
            x = r.random()
            if x < 0.27:
                s, own = self.line(r.choice(self.cases))
            elif x < 0.35:
                s, own = self.labelled()
            elif x < 0.43:
                s, own = self.record()
            elif x < 0.57:
                s, own = self.carried()
            elif x < 0.74:
                s, own = self.line(r.choice(self.near))
            elif x < 0.86:
                s, own = self.line(r.choice(self.plain))
            else:
                s, own = self.sentence() if r.random() < 0.4 else self.noted(), []
            if k:
                out += r.choice(["\n", "\n", "\n", " ", " ", ". ", "\n\n", ", ", "; ", " - "])
            spans += [(a + len(out), b + len(out), kind) for a, b, kind in own]
            out += s
        return out, spans


_NEAR = frozenset(NEAR)


def tags_of(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(text), dtype=np.int64)
    for a, b, kind in spans:
        y[a] = TAGS[kind, "B"]
        y[a + 1 : b] = TAGS[kind, "I"]
    return y


def _batch(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = len(rows), max(len(x) for x, _ in rows)
    x, y, length = np.zeros((n, size), dtype=np.int64), np.zeros((n, size), dtype=np.int64), np.array([len(a) for a, _ in rows])
    for i, (a, b) in enumerate(rows):
        x[i, : len(a)], y[i, : len(b)] = a, b
    return x, y, length


_ROWS: list[tuple[np.ndarray, np.ndarray]] = []


def _shard(job: tuple[dict[str, np.ndarray], list[int]]) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, characters and gradient of a share of a batch; the rows came with the fork."""
    weights, index = job
    batch = _batch([_ROWS[i] for i in index])
    loss, grad = Tagger(weights).loss(*batch)
    return loss, int(batch[2].sum()), grad


def train(texts: int = TEXTS, hidden: int = 80, epochs: int = 6, batch: int = 128, seed: int = 11, rate: float = 4e-3, workers: int = 1, held: bool | None = False, start: Tagger | None = None, log=print) -> Tagger:
    """Adam on the negative log-likelihood of the tags; batches of like length, a linear decay of the rate.

    With ``workers`` every batch is cut into as many shares, whose gradients are added up by their characters. ``start``
    is trained on.
    """
    g = Generator(seed, held)
    _ROWS.clear()
    while len(_ROWS) < texts:
        t, spans = g.text()
        if t:
            _ROWS.append((encode_chars(t), tags_of(t, spans)))
    tagger = start or Tagger.fresh(hidden, seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    step, per_epoch = 0, -(-len(_ROWS) // batch)
    pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
    for epoch in range(epochs):
        order = sorted(range(len(_ROWS)), key=lambda i: (len(_ROWS[i][0]) // 12, rng.random()))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        total, began = 0.0, time.time()
        for group in groups:
            jobs = [(tagger.w, group[k::workers]) for k in range(workers) if group[k::workers]]
            parts = pool.map(_shard, jobs, 1) if pool else [_shard(jobs[0])]
            chars = sum(c for _, c, _ in parts)
            total += sum(x * c for x, c, _ in parts) / chars
            grad = {k: sum(p[2][k] * (p[1] / chars) for p in parts) for k in tagger.w}
            step += 1
            now = rate * max(0.05, 1 - step / (epochs * per_epoch))
            norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
            for k, x in grad.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                tagger.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        log(f"epoch {epoch + 1}: loss {total / len(groups):.4f}, {time.time() - began:.0f} s", flush=True)
    if pool:
        pool.terminate()
    return tagger


def scores(tagger: Tagger, texts: int = 2000, seed: int = 99, held: bool = True) -> dict[str, tuple[float, float]]:
    """(precision, recall) of exact spans by kind on texts of names, lines and formats that training did not see."""
    g = Generator(seed, held)
    data = [g.text() for _ in range(texts)]
    found = tagger.find([t for t, _ in data])
    out = {}
    for kind in KINDS:
        want = {(i, a, b) for i, (_, spans) in enumerate(data) for a, b, k in spans if k == kind}
        got = {(i, a, b) for i, spans in enumerate(found) for a, b, k in spans if k == kind}
        out[kind] = (round(len(want & got) / max(1, len(got)), 4), round(len(want & got) / max(1, len(want)), 4))
    return out


if __name__ == "__main__":
    cores = os.cpu_count() or 1
    model = train(workers=cores)
    print("held out", scores(model), "drawn from the lists of training", scores(model, held=False), flush=True)
    # What is shipped goes on from there, on new texts of all lists, in smaller steps.
    model = train(epochs=3, batch=64, seed=12, rate=2.5e-3, workers=cores, held=None, start=model)
    model.save(sys.argv[1])
    print("shipped, new texts of all lists", scores(model, held=None))
