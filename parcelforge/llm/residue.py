"""Template residue and error-page text, found by character n-gram models.

Two sets of models. Letters: n-grams of natural prose, headings, site navigation, notices and filler; every position of a text gets
the log likelihoods of a window of n-grams, the best class names it, and a text is excluded if notices and filler cover most of what
is neither heading nor navigation. Shapes: n-grams over runs of signs of one kind (a lower-case word, a number, two braces), in which
a template field looks alike whatever its label; windows in which unfilled fields are likelier than running text and than quoted
fields mark residue, and a text is excluded if they cover the length of a field.

The models start from general wordings. They are then fitted on the corpus, each different text once, whole: prose, headings and
shapes of text on what is kept, and navigation, notices and filler on what is excluded, so that a corpus's own wordings are learnt.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.operators.joins import bounded
from parcelforge.session import cut_lineage

CLASSES = ("prose", "heading", "navigation", "notice", "filler")
PROSE, HEADING, NAVIGATION, NOTICE, FILLER = range(len(CLASSES))
SHAPES = ("text", "field", "quoted")
TEXT, FIELD, QUOTED = range(len(SHAPES))

#: Characters of an n-gram, table size, and characters of a window on each side.
NGRAM, BUCKETS, REACH = 5, 1 << 20, 9
#: Likelihood below which an n-gram tells nothing.
FLOOR = 3e-7
#: Share of notices and filler from which a text is excluded, and the least characters of them.
COVERAGE, LEAST_TOLD = 0.5, 12
#: Runs of a shape n-gram, table size, n-grams of a window, log likelihood ratio of a window of fields, and characters of a field.
SHAPE_GRAM, SHAPE_BUCKETS, SHAPE_WINDOW, FIELD_RATIO, FIELD_CHARS = 4, 1 << 18, 6, 6.0, 2
#: Likelihood below which a shape n-gram tells nothing.
SHAPE_FLOOR = 1e-6
#: Signs told apart, besides letters, digits and spaces, and those by which a field can open or close.
SIGNS = ".,;:!?'\"()[]{}<>_|#$%&*+-/=@©…"
_FIELD_SIGN = np.zeros(64, bool)
_FIELD_SIGN[[30 + SIGNS.index(c) for c in "\"[]{}<>_#$%…"]] = True
#: Characters round a sign in which shapes are looked at.
SIGN_REACH = 48
#: Positions from one window of letters to the next; windows reach over several steps, so that no character is left out.
STEP = 4
#: Texts whose shapes are looked at together.
TOGETHER = 32
#: Fits on the corpus.
FITS = 2

# General wordings of error pages and of notices about scripts, cookies and browsers.
NOTICE_SEEDS = """
Oups ! Cette page n'est plus là. Nous n'avons pas trouvé la page que vous recherchez. Page inexistante. Page introuvable.
L'URL demandée n'a pas été trouvée sur ce serveur. Si vous avez saisi l'adresse à la main, vérifiez l'orthographe et réessayez.
Vous n'avez pas le droit d'accéder à l'objet demandé. Accès non autorisé. Accès interdit : vous devez être connecté pour voir ce contenu.
Le serveur a rencontré une erreur interne et n'a pas pu traiter votre requête. Erreur interne du serveur. Une erreur est survenue.
Numéro d'incident à rappeler au support technique. Code d'erreur. Quelque chose s'est mal passé. Erreur inconnue, requête invalide.
Session expirée. Identifiez-vous à nouveau pour continuer. Votre connexion a été fermée après une longue période d'inactivité.
Service indisponible pour cause de maintenance. Veuillez réessayer dans quelques minutes. Le site est en cours de maintenance.
Limite de requêtes atteinte. Vous avez effectué un trop grand nombre de requêtes, attendez quelques secondes. Adresse IP bloquée.
Le délai d'attente est dépassé. La connexion au serveur a échoué. Connexion à la base de données impossible. Passerelle incorrecte.
La ressource a été supprimée ou déplacée. Le fichier n'est plus disponible. Le document n'existe pas. Lien rompu ou périmé.
JavaScript doit être activé pour utiliser ce site. Merci d'activer JavaScript. JavaScript est désactivé ou bloqué par votre navigateur.
Les scripts sont désactivés : cette application ne peut pas s'afficher ni fonctionner. Autorisez l'exécution des scripts.
Les cookies doivent être activés. Acceptez les cookies pour poursuivre votre visite. Nous utilisons des cookies.
Nous vérifions votre navigateur, cela prend quelques secondes. Vérification de sécurité en cours. Vérifiez que vous n'êtes pas un robot.
Navigateur obsolète ou non pris en charge. Mettez à jour votre navigateur ou installez un navigateur récent.
Oops! We can't find the page you are looking for. This page does not exist. Not Found. The server can not find the requested page.
Forbidden. Access to this resource on the server is denied. You are not authorized to access this page. Permission denied. Login required.
The server encountered an internal error or misconfiguration and was unable to complete your request. We're sorry, but something went wrong.
Error code, incident id, request id. Please contact the administrator. Unexpected error. Bad request. Unknown error.
Session timed out. Log in again to continue. You must be logged in to see this content. You have been signed out.
Service unavailable. The site is down for maintenance, please try again in a few minutes. The server is temporarily unable to handle requests.
Rate limit exceeded. You sent too many requests in a short time, slow down and retry after some seconds. You have been blocked.
The connection has timed out. The upstream server took too long to respond. Bad gateway. Gateway timeout. Error establishing a database connection.
This file has been removed or is no longer available. The link is broken or expired. Content moved.
JavaScript is disabled in your browser. JavaScript is required to use this site. Please enable JavaScript to continue. Turn JavaScript on.
Scripts are blocked, so this application can not be displayed. Allow scripts to run.
Enable cookies and reload the page. Cookies must be enabled. We use cookies, accept them to go on.
Just a moment, we are checking that your browser is secure. Verify that you are not a robot. Performing a security check.
Your browser is out of date or not supported. Upgrade to a modern browser.
Die Seite existiert nicht. Diese Seite konnte leider nicht gefunden werden. Nicht gefunden. Der angeforderte URL fehlt auf dem Server.
Zugriff nicht erlaubt. Sie sind nicht berechtigt, auf diesen Inhalt zuzugreifen. Bitte loggen Sie sich ein. Zugang verweigert.
Interner Fehler des Servers. Der Server konnte Ihre Anfrage nicht bearbeiten. Es ist ein Fehler aufgetreten. Fehlercode, Vorfallnummer.
Sitzung abgelaufen, melden Sie sich neu an. Sie wurden abgemeldet. Bitte Anmeldung wiederholen.
Wegen Wartung geschlossen. Der Dienst steht zurzeit nicht zur Verfügung. Versuchen Sie es in wenigen Minuten noch einmal.
Zu viele Zugriffe in kurzer Zeit, bitte einige Sekunden warten. Zeitüberschreitung der Verbindung. Keine Verbindung zum Server.
Die Datei wurde gelöscht oder verschoben. Der Link ist veraltet. Das Dokument ist nicht mehr verfügbar.
Dieser Inhalt wird nur mit aktiviertem JavaScript angezeigt. JavaScript ist in Ihrem Browser deaktiviert. Skripte werden blockiert. Aktivieren Sie Skripte.
Cookies sind ausgeschaltet. Bitte erlauben Sie Cookies, um fortzufahren. Wir verwenden Cookies.
Einen Moment bitte, Ihr Browser wird überprüft. Bestätigen Sie, dass Sie kein Roboter sind. Sicherheitsüberprüfung läuft.
Veralteter Browser. Ihr Browser wird nicht mehr unterstützt, bitte aktualisieren.
"""

# Words of the common filler passage in no order, and words and wordings of filler of general use.
LOREM_WORDS = (
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea"
    " eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna"
    " minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut"
    " velit veniam voluptate"
)
FILLER_WORDS = (
    "asdf azerty blabla dummy factice faux filler lipsum placeholder qwerty qwertz remplissage sample tbd test todo xxx"
    " Blindtext Beispieltext Mustertext Platzhalter"
)
FILLER_SEEDS = """
Faux-texte de démonstration. Texte provisoire. Ce paragraphe est un exemple, remplacez-le par votre texte. Votre texte ici.
Contenu bientôt disponible. Page en construction. Le contenu sera ajouté plus tard. À venir. Insérer le texte ici. Texte à remplacer.
Dummy text for demonstration. This paragraph is only an example, replace it with your own text. Your text goes here.
Content will be added later. Page under construction. Coming soon. Insert text here. To be replaced. Sample text.
Nur ein Blindtext. Dieser Absatz dient als Beispiel und wird noch ersetzt. Hier steht später Ihr Text.
Inhalt in Vorbereitung. Seite im Aufbau. Der Inhalt folgt in Kürze. Text hier einfügen. Bitte Text ersetzen.
"""

# General items of site navigation.
NAVIGATION_SEEDS = """
Passer au contenu
Menu principal
Accueil
Rechercher
Nous contacter
Contact
Se connecter
Créer un compte
Connexion
Inscription
Mon compte
Plan du site
Mentions légales
Confidentialité
Retour en haut de page
Retour aux résultats
Liste des résultats
Partager
Imprimer
Fil d'Ariane
Jump to navigation
Main content
Home
Search
About us
Contact us
Log in
Sign up
Register
Sitemap
Site map
Legal notice
Privacy policy
Terms of use
Back to top
Search results
Print this page
Zum Hauptinhalt
Startseite
Suche
Kontakt
Impressum
Datenschutzerklärung
Nutzungsbedingungen
Anmelden
Registrieren
Zurück zur Übersicht
Seite drucken
Nach oben
© Tous droits réservés
© All rights reserved
© Alle Rechte vorbehalten
"""

# General wordings of a decision's head besides those the corpus shows.
HEADING_SEEDS = """
ENTRE : , demeurant à
ET :
contre
c/
v
gegen
RÉPUBLIQUE FRANÇAISE
Décision du
ARRÊT DU
JUGEMENT DU
Urteil vom
Judgment of
"""

# Seed wordings of prose, for corpora that show little of it.
PROSE_SEEDS = """
Vu la procédure suivante : par une requête et un mémoire enregistrés au greffe, la société demande au tribunal d'annuler la décision par laquelle le
préfet a rejeté sa demande et de mettre à la charge de l'État une somme au titre des frais exposés et non compris dans les dépens. Elle soutient que
la décision attaquée est entachée d'une erreur de droit et d'une erreur manifeste d'appréciation, qu'elle n'est pas suffisamment motivée et qu'elle
méconnaît les dispositions du code de l'urbanisme. Par un mémoire en défense, le défendeur conclut au rejet de la requête et fait valoir que les
moyens soulevés ne sont pas fondés. Considérant qu'il résulte de l'instruction que le contrat de bail a été conclu entre les parties pour une durée
de neuf ans ; que le bailleur a donné congé au preneur par acte d'huissier ; que le locataire n'a pas réglé les loyers et les charges dus. Attendu que
la cour d'appel a relevé, par motifs propres et adoptés, que le vendeur avait connaissance des vices cachés de l'immeuble et que l'acquéreur était
fondé à demander la résolution de la vente ainsi que des dommages et intérêts. Il ressort des pièces du dossier que le salarié a été licencié pour
faute grave et que l'employeur ne rapporte pas la preuve des faits allégués. En conséquence, il y a lieu de confirmer le jugement déféré en toutes ses
dispositions, de débouter l'appelant de ses demandes et de le condamner aux dépens. Aux termes de l'article du code civil, les conventions légalement
formées tiennent lieu de loi à ceux qui les ont faites. Le tribunal, statuant publiquement par jugement contradictoire et en premier ressort, ordonne
l'expertise, désigne l'expert et dit que les frais seront avancés par la partie demanderesse. La parcelle cadastrée est située dans la commune.
The claimant brought proceedings against the defendant for breach of contract and sought damages for the loss which had been suffered. The judge found
that the agreement had been made between the parties and that the terms were clear. It was submitted on behalf of the appellant that the court below
had erred in law in holding that there was no duty of care. We do not accept that submission. The evidence of the witness was that the tenant had paid
the rent until the end of the year, and that the landlord had given notice to quit. In our judgment the tribunal was entitled to reach that conclusion
on the facts before it. The question is whether the statute applies to the circumstances of the present case. Having considered the authorities, I am
satisfied that the decision was reasonable, so that nothing is left of the application. The respondent argued that the claim was out of time and that there was
no reason to extend the limitation period. It follows that the appeal must be dismissed; the order of the lower court stands, with costs.
Die Klägerin nimmt den Beklagten auf Zahlung von Schadensersatz wegen Verletzung des Vertrages in Anspruch. Das Landgericht hat die Klage abgewiesen,
das Berufungsgericht hat die dagegen gerichtete Berufung zurückgewiesen. Mit der Revision verfolgt die Klägerin ihr Begehren weiter. Die Revision ist
unbegründet. Nach den Feststellungen des Gerichts haben die Parteien einen Mietvertrag über das Grundstück geschlossen, der durch die Kündigung des
Vermieters beendet worden ist. Der Senat ist der Auffassung, dass die Voraussetzungen des Anspruchs nicht vorliegen, weil der Beklagte die Frist
nicht versäumt hat. Die Entscheidung über die Kosten beruht auf den Vorschriften der Zivilprozessordnung. Das Urteil ist vorläufig vollstreckbar.
Entgegen der Ansicht der Beschwerde kommt es nicht darauf an, ob die Behörde bei ihrer Entscheidung von einem unrichtigen Sachverhalt ausgegangen ist.
"""

# General wordings of short orders, which are prose however short the decision is.
ORDER_SEEDS = """
La requête est rejetée. Il est donné acte du désistement. L'instance est éteinte. L'affaire est renvoyée à une audience ultérieure. Les dépens sont réservés.
Déclare l'appel irrecevable. Ordonne la jonction des instances. Radie l'affaire du rôle. Rejette le pourvoi. Désigne un expert. Sursoit à statuer.
Rejette les requêtes du syndicat. La requête de la commune est rejetée. Donne acte à la société de son désistement. Fixe l'audience au mois de mai.
The application is refused. The hearing is adjourned. No order is made as to costs. The claim has been withdrawn. The appeal is dismissed. Leave to appeal is granted.
Der Antrag wird zurückgewiesen. Die Verhandlung wird vertagt. Die Klage wird abgewiesen. Die Kosten trägt der Kläger. Das Verfahren wird eingestellt.
"""

# General ways of redaction.
REDACTION_SEEDS = """
M. [X], demeurant [Adresse 2] à [Localité 1], né le [Date naissance 3]. Mme [A] [B] contre M. [Z]. A.________ et B.________ ont saisi. M. X... et Mme Y... ;
la société [...] a cédé [...], et M. A... soutient que (...) la cour [sic] retient. Le mot (illisible) figure (sic) au plan, voir (1), (n° 12) et (p. 3). [1] Le demandeur. [12] The firm [X] and Ms [Y] in [Locality 4], see [2001] 2 AC 3.
"""

# Words by which a template asks to be filled, and where a field stands.
ORDER_WORDS = (
    "insérer inserer compléter completer renseigner remplir saisir indiquer préciser ici insert enter fill completed filled here"
    " einsetzen eingeben einfügen ausfüllen ergänzen hier"
).split()

# Signs of template languages and of printed forms; {} is a label. `order` stands for any word of ORDER_WORDS.
FIELD_FORMS = (
    "{{{}}}", "{{ {} }}", "{% {} %}", "${{}}", "%({})s", "%{}%", "[[{}]]", "<<{}>>", "#{}#", "{{{{}}}}",
    "....... ({})", ".......({})", "______ ({})", "______({})", "…… ({})",
    "<order {}>", "<{} order>", "[order {}]", "[{} order]", "[{} À order]", "[{} à order]", "[{} to be order]", "[{} TO BE order]", "[à order : {}]",
)
QUOTE_FORMS = ("«{} order»", "«order {}»", "„{} order“", "„order {}“", "“{} order”", "“order {}”")
FIELD_LABELS = ("nom", "nom_nom", "nom nom", "nom nom nom", "nom d'nom", "nom_nom_nom", "NOM", "NOM_NOM", "NOM NOM", "NOM NOM NOM", "NOM D'NOM", "Nom", "Nom nom", "Nom Nom", "nom2", "NOM_2")
BEFORE = ("\n", "nom ", "nom, ", "nom : ", "° ", "nom. ", "nom (", "d'", "12 ", "] ", "M. ")
AFTER = ("\n", " nom", ", nom", ", 12", ".\n", ". Nom", " Nom", ")", " (", " 12", " :", ";")
QUOTES = ("« {} »", "«{}»", '"{}"', "“{}”", "„{}“", "‘{}’", "'{}'", "‹ {} ›")
QUOTED_WORDS = ("nom nom nom nom nom nom", "Nom nom nom nom nom", "Nom 12", "Nom 12 - nom nom", "Nom 12 – Nom nom nom", "Nom nom Nom nom.", "nom, nom nom", "nom-nom")
QUOTED_BEFORE, QUOTED_AFTER = ("nom ", "nom : ", "(", "\n", ", "), (" nom", ", nom", ".\n", ". Nom", ")", "\n", " ;")

_ORDER = re.compile(rf"(?i)(?<![^\W_])(?:{'|'.join(ORDER_WORDS)})(?![^\W_])")
#: Bracketed or quoted spans, in which alone words of ORDER_WORDS are looked for.
_SPAN = re.compile(r"""[\[<«„“"'‘‹(][^\[\]<>«»„“”"‘‹›()\n]{2,80}[\]>»“”"'’›)]""")


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol below 64 of every code point: letters without accents and case, digits as one, signs by kind."""
    table = np.full(0x110000, 63, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        bare = unicodedata.normalize("NFKD", ch)[:1].lower()
        kind = unicodedata.category(ch)
        if "a" <= bare <= "z":
            table[c] = 1 + ord(bare) - 97
        elif kind[0] == "N":
            table[c] = 27
        elif ch in "\n\r\v\f":
            table[c] = 29
        elif kind[0] == "Z" or ch == "\t":
            table[c] = 28
        elif kind == "Pd":
            table[c] = 30 + SIGNS.index("-")
        elif kind in ("Pi", "Pf") or ch == "„":
            table[c] = 30 + SIGNS.index("'" if ch in "‘’" else '"')
        elif ch in SIGNS:
            table[c] = 30 + SIGNS.index(ch)
    return table


@lru_cache(maxsize=2)
def byte_symbols(encoding: str) -> bytes:
    """The symbol of every byte of a one-byte encoding."""
    return bytes(int(symbol_table()[ord(bytes([b]).decode(encoding, "replace"))]) for b in range(256))


def symbols(text: str) -> np.ndarray:
    """The symbol of each character; texts of Western letters and typographic signs go by bytes, which is much faster."""
    for encoding in ("latin-1", "cp1252"):
        try:
            return np.frombuffer(text.encode(encoding).translate(byte_symbols(encoding)), np.uint8)
        except UnicodeEncodeError:
            pass
    return symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def buckets(text: str, of: np.ndarray | None = None) -> np.ndarray:
    """Bucket of the n-gram that starts at each position (n-grams over the end are padded); `of`: its symbols, if known."""
    s = np.concatenate([symbols(text) if of is None else of, np.full(NGRAM - 1, 28, np.uint8)]).astype(np.uint32)
    two = (s[:-1] << np.uint32(6)) ^ s[1:]
    key = (((two[:-3] << np.uint32(12)) ^ two[2:-1]) << np.uint32(6)) ^ s[4:]
    return ((key * np.uint32(2654435761)) >> np.uint32(12)).astype(np.intp)


@lru_cache(maxsize=1)
def kind_table() -> np.ndarray:
    """Kind below 64 of every code point: lower-case letter, capital, digit, space, line end, each common sign, other."""
    table = np.full(0x110000, 63, np.uint8)
    table[0], table[1] = 0, 7
    signs = ".,;:!?'\"()[]{}<>_|#$%&*+-/=@«»„“”‘’‹›…°§"
    for c in range(2, 0x3000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch in signs:
            table[c] = 10 + signs.index(ch)
        elif kind[0] in "LM":
            table[c] = 2 if kind in ("Lu", "Lt") else 1
        elif kind[0] == "N":
            table[c] = 3
        elif ch in "\n\r\v\f":
            table[c] = 5
        elif kind[0] == "Z" or ch == "\t":
            table[c] = 4
        elif kind == "Pd":
            table[c] = 10 + signs.index("-")
    table[0x3000:0x20000] = 1
    return table


def near_signs(text: str, of: np.ndarray | None = None) -> str:
    """The parts of a text that lie within SIGN_REACH of a sign by which a field can open or close, joined by a character of no kind.
    Elsewhere no n-gram of a field can be. `of`: the text's symbols, if known."""
    s = symbols(text) if of is None else of
    sign = _FIELD_SIGN[s]
    dot = s == 30 + SIGNS.index(".")
    if len(s) > 3:
        sign[3:] |= dot[:-3] & dot[1:-2] & dot[2:-1] & dot[3:]
    at = np.flatnonzero(sign)
    if not len(at):
        return ""
    new = np.flatnonzero(np.diff(at) > 2 * SIGN_REACH) + 1
    low, high = np.maximum(at[np.concatenate([[0], new])] - SIGN_REACH, 0), at[np.concatenate([new - 1, [len(at) - 1]])] + SIGN_REACH
    return "\0".join([text[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)])


def shapes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the shape n-gram that starts at each run of a text near signs, and the start of each run. A run is characters of one
    kind; signs tell one, two and more of a kind apart, capitals one and more."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind_table()[codes]
    for span in _SPAN.finditer(text):
        for word in _ORDER.finditer(text, span.start() + 1, span.end() - 1):
            if word.start() == span.start() + 1 or word.end() == span.end() - 1:
                kinds[word.start() : word.end()] = 6
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    length = np.diff(starts, append=len(kinds))
    of = kinds[starts].astype(np.uint64)
    many = np.where(of >= 10, np.minimum(length, 3), np.where(of == 2, np.minimum(length, 2), 1)).astype(np.uint64)
    edge = np.array([0] * (SHAPE_GRAM - 2) + [5 << 2 | 1], np.uint64)  # a text stands between line ends
    runs = np.concatenate([edge, of << np.uint64(2) | many, edge[::-1]])
    key = np.zeros(len(runs) - SHAPE_GRAM + 1, np.uint64)
    for i in range(SHAPE_GRAM):
        key = (key << np.uint64(8)) | runs[i : i + len(key)]
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)
    return bucket, starts


class Shapes:
    """Shapes of the parts near signs of several texts, looked at together: bucket of each n-gram, size of each run, the runs at which
    the texts begin, and the n-grams that reach over two texts."""

    def __init__(self, nears: list[str]):
        parts = [f"\n{near}\n\x01" for near in nears]
        whole = "".join(parts)
        self.bucket, starts = shapes(whole)
        self.size = np.diff(starts, append=len(whole))
        self.bounds = np.searchsorted(starts, np.cumsum([0, *map(len, parts)]))
        ends = self.bounds[1:] - 1
        self.between = (ends[:, None] + np.arange(SHAPE_GRAM)).ravel()

    def buckets_of(self, i: int) -> np.ndarray:
        """The n-grams that lie in text i."""
        return self.bucket[self.bounds[i] + SHAPE_GRAM - 1 : self.bounds[i + 1] - 1]


def head_of(text: str) -> int:
    """End of the lines that stand before a decision's first paragraph."""
    at = 0
    for line in text.split("\n")[:8]:
        if not line.strip() or len(line) > 120 or re.match(r"\s*(?:\[\d+\]|§\s*\d|\d+\s?[.)])", line):
            break
        at += len(line) + 1
    return min(at, len(text))


class Models:
    """Log likelihoods of each bucket under each class.

    Letters are in quarters of a natural logarithm; the classes of a bucket lie side by side in one number, ten bits each, so that one
    running sum adds up all of them; a window's sums fit, and wrapping does no harm to their differences. Shapes are the log ratio of
    an unfilled field to the likelier of running text and a quoted field."""

    def __init__(self, counts: np.ndarray, shape_counts: np.ndarray, texts: float):
        """One row a class and one column a bucket, of letters and of shapes; the number of texts learnt from."""
        logs = np.log(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + FLOOR) - np.log(FLOOR)
        self.packed = np.zeros(BUCKETS, np.uint64)
        for k, row in enumerate(np.round(logs * 4).clip(0, 63).astype(np.uint64)):
            self.packed |= row << np.uint64(10 * k)
        told = np.log(shape_counts / np.maximum(shape_counts.sum(axis=1, keepdims=True), 1) + SHAPE_FLOOR)
        self.ratio = (told[FIELD] - np.maximum(told[TEXT], told[QUOTED])).astype(np.float32)
        self.texts = texts

    def classes(self, text: str, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The class of every STEP-th position of a text (`found`: its buckets, if known), of equals the first, and whether anything
        tells it."""
        found = buckets(text) if found is None else found
        n, behind = len(found), REACH - NGRAM + 2
        # the running sum with its first value repeated before it and its last one behind it, so that windows end at the text's ends
        total = np.zeros(REACH + n + 1 + behind, np.uint64)
        np.cumsum(self.packed[found], out=total[REACH + 1 : REACH + 1 + n])
        total[REACH + 1 + n :] = total[REACH + n]
        sums = (total[REACH + behind : REACH + behind + n : STEP] - total[:n:STEP]).view(np.int64)
        last = len(CLASSES) - 1
        best = np.full(len(sums), -1, np.int16)
        for k in range(last + 1):
            of_class = (sums >> 10 * k).astype(np.int16)
            of_class &= 1023
            of_class <<= 3
            of_class |= last - k
            np.maximum(best, of_class, out=best)
        return last - (best & 7), best >= 8

    def field_chars(self, shaped: Shapes) -> np.ndarray:
        """Characters in windows of unfilled fields, for each of the texts."""
        ratio = self.ratio[shaped.bucket]
        ratio[shaped.between] = 0.0
        total = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        # no window reaches over the end of its text
        low = np.arange(len(shaped.size))
        end = np.repeat(shaped.bounds[1:] - 1, np.diff(shaped.bounds))
        hits = np.flatnonzero(total[np.minimum(low + SHAPE_WINDOW, end)] - total[low] >= FIELD_RATIO)
        # the runs all of whose n-grams lie in a window: n-gram i covers the runs from i - SHAPE_GRAM + 1 on, by their numbers
        covered = np.zeros(len(shaped.size), bool)
        for k in range(SHAPE_WINDOW - SHAPE_GRAM + 1):
            covered[np.minimum(hits + k, end[hits] - 1)] = True
        chars = np.concatenate([[0], np.cumsum(np.where(covered, shaped.size, 0))])
        return np.diff(chars[shaped.bounds])


def _seed_wordings() -> Iterator[tuple[int, str, float]]:
    yield PROSE, PROSE_SEEDS, 1.0
    for k, seeds in ((NOTICE, NOTICE_SEEDS), (NAVIGATION, NAVIGATION_SEEDS), (FILLER, FILLER_SEEDS)):
        for s in seeds.strip().splitlines():
            yield k, s + "\n", 1.0
    for listed in (LOREM_WORDS.split(), FILLER_WORDS.split()):
        for i in range(6):  # words of filler in changing orders
            yield FILLER, " ".join(listed[j * (3 + 2 * i) % len(listed)] for j in range(len(listed))) + ".\n", 0.5


@lru_cache(maxsize=1)
def _seed_counts() -> np.ndarray:
    """N-grams of letters of the seed wordings."""
    counts = np.zeros((len(CLASSES), BUCKETS))
    for k, text, weight in _seed_wordings():
        np.add.at(counts[k], buckets(text), weight)
    return counts


@lru_cache(maxsize=1)
def _seed_shapes() -> np.ndarray:
    """N-grams of shapes of fields, quoted fields, and the text seeds."""
    counts = np.zeros((len(SHAPES), SHAPE_BUCKETS))
    fill = lambda form, label: form.replace("{}", label, 1).replace("order", "insert")
    open_fields = [fill(f, x) for f, x in product(FIELD_FORMS, FIELD_LABELS)]
    all_open = open_fields + [fill(f, x) for f, x in product(QUOTE_FORMS, FIELD_LABELS)]


    def add(k: int, examples: list[tuple[str, str, str]]) -> None:
        """N-grams that reach into the middle parts of the examples (before, middle, after)."""
        bucket, starts = shapes("\n".join(map("".join, examples)))
        ends = np.cumsum([len(b) + len(m) + len(a) + 1 for b, m, a in examples])
        which = np.searchsorted(ends, starts, side="right")
        low = ends - 1 - [len(m) + len(a) for _, m, a in examples]
        high = ends - 1 - [len(a) for *_, a in examples]
        inside = (starts >= low[which]) & (starts < high[which])
        # n-gram i covers the runs from i - SHAPE_GRAM + 1 to i
        reached = np.convolve(inside, np.ones(SHAPE_GRAM, int)) > 0
        np.add.at(counts[k], bucket[reached], 1.0)

    for f in all_open:
        add(FIELD, [(b, f, a) for b, a in product(BEFORE, AFTER)])
    for f in open_fields + [f"[{x}]" for x in FIELD_LABELS] + [*FIELD_LABELS, *QUOTED_WORDS]:
        add(QUOTED, [(b, q.replace("{}", f), a) for q, b, a in product(QUOTES, QUOTED_BEFORE, QUOTED_AFTER)])
    for s in (PROSE_SEEDS, ORDER_SEEDS, REDACTION_SEEDS, NOTICE_SEEDS, NAVIGATION_SEEDS, HEADING_SEEDS):
        np.add.at(counts[TEXT], shapes(s)[0], 1.0)
    return counts


class Shown:
    """What texts have shown: letters by class, shapes of text, and the weight of the texts kept."""

    def __init__(self, letters: np.ndarray | None = None, shapes: np.ndarray | None = None, texts: float = 0.0):
        self.letters = np.zeros((len(CLASSES), BUCKETS)) if letters is None else letters
        self.shapes = np.zeros(SHAPE_BUCKETS) if shapes is None else shapes
        self.texts = texts
        self._open: dict[int, list[tuple[np.ndarray, float]]] = {}
        self._size = 0

    def _count(self, k: int, found: np.ndarray, weight: float) -> None:
        self._open.setdefault(k, []).append((found, weight))
        self._size += len(found)
        if self._size > 4 * BUCKETS:
            self.close()

    def close(self) -> Shown:
        """Add up what is still open."""
        for k, parts in self._open.items():
            row = self.letters[k] if k >= 0 else self.shapes
            for weight in {w for _, w in parts}:
                row += weight * np.bincount(np.concatenate([f for f, w in parts if w == weight]), minlength=len(row))
        self._open, self._size = {}, 0
        return self

    def add(self, texts: list[str], weights: list[float], models: Models) -> None:
        for at in range(0, len(texts), TOGETHER):
            self._add(texts[at : at + TOGETHER], weights[at : at + TOGETHER], models)

    def _add(self, texts: list[str], weights: list[float], models: Models) -> None:
        of = [symbols(t) for t in texts]
        shaped = Shapes([near_signs(t, s) for t, s in zip(texts, of, strict=True)])
        for i, (text, weight, field_chars) in enumerate(zip(texts, weights, models.field_chars(shaped).tolist(), strict=True)):
            found = buckets(text, of[i])
            k, told = models.classes(text, found)
            v = verdict(k, told, field_chars)
            if is_told(v):  # the parts that are told; unknown wordings of the same text follow in the next fit
                at, told = np.repeat(k, STEP)[: len(found)], np.repeat(told, STEP)[: len(found)]
                for c in (NAVIGATION, NOTICE, FILLER):
                    self._count(c, found[told & (at == c)], weight)
                continue
            if models.texts and has_field(v):  # the seeds alone don't show enough text to tell fields from it
                continue
            head = head_of(text)
            self._count(HEADING, buckets(text[:head]), weight)
            self._count(PROSE, found[head:], weight)
            self._count(-1, shaped.buckets_of(i), weight)
            self.texts += weight


def models_of(shown: Shown | None = None) -> Models:
    """Models of the seeds and of what the texts have shown (none: the seeds alone)."""
    counts, shape_counts = _seed_counts().copy(), _seed_shapes().copy()
    texts = shown.texts if shown else 0.0
    for s in HEADING_SEEDS.strip().splitlines():
        np.add.at(counts[HEADING], buckets(s + " "), max(1.0, texts / 4))
    np.add.at(counts[PROSE], buckets(ORDER_SEEDS), max(1.0, texts / 20))
    if shown is not None:
        counts += shown.letters
        shape_counts[TEXT] += shown.shapes
    return Models(counts, shape_counts, texts)


@dataclass
class Verdict:
    notice: int
    filler: int
    prose: int
    field_chars: int


def verdict(k: np.ndarray, told: np.ndarray, field_chars: int) -> Verdict:
    size = np.bincount(k[told], minlength=len(CLASSES)) * STEP
    return Verdict(int(size[NOTICE]), int(size[FILLER]), int(size[PROSE]), field_chars)


def judge_all(texts: list[str], models: Models) -> list[Verdict]:
    out = []
    for at in range(0, len(texts), TOGETHER):
        some = texts[at : at + TOGETHER]
        of = [symbols(t) for t in some]
        fields = models.field_chars(Shapes([near_signs(t, s) for t, s in zip(some, of, strict=True)]))
        out += [verdict(*models.classes(t, buckets(t, s)), f) for t, s, f in zip(some, of, fields.tolist(), strict=True)]
    return out


def judge(text: str, models: Models) -> Verdict:
    return judge_all([text], models)[0]


def is_told(v: Verdict, coverage: float = COVERAGE) -> bool:
    told = v.notice + v.filler
    return told >= LEAST_TOLD and told >= coverage * (told + v.prose)


def has_field(v: Verdict) -> bool:
    return v.field_chars >= FIELD_CHARS


def is_residue(v: Verdict) -> bool:
    return is_told(v) or has_field(v)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, TOGETHER):
        yield batch.slice(at, TOGETHER)


def with_text(docs: DataFrame) -> DataFrame:
    """Rows whose text is not null, empty or blank."""
    return docs.where(F.col("text").rlike(r"(?U)\S"))


def different_texts(docs: DataFrame) -> DataFrame:
    """(text, weight) of every row with text; the weights of a text's copies add up to one."""
    h = F.xxhash64("text", F.length("text")).alias("h")
    copied = with_text(docs).select(h).groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = with_text(docs).select("text", h).join(bounded(cut_lineage(copied), 500_000), "h", "left")
    return rows.select("text", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"))


def fit_on(docs: DataFrame) -> Models:
    """Models of a corpus, from all its texts, whole, each different text once, fitted FITS times, the first time on what the seeds
    alone keep and exclude, then on what the last models do.

    Each task adds its texts up in tables of buckets; the driver gets at most one row a bucket for any corpus."""
    texts, models = different_texts(docs), models_of()
    for _ in range(FITS):
        models = _fit(texts, models)
    return models


def fit_models(texts: list[str]) -> Models:
    """What `fit_on` does, of texts at hand."""
    models = models_of()
    for _ in range(FITS):
        shown = Shown()
        different = list(dict.fromkeys(texts))
        shown.add(different, [1.0] * len(different), models)
        models = models_of(shown.close())
    return models


def _fit(texts: DataFrame, models: Models) -> Models:
    """Models of `texts` (text, weight), given those that tell what is kept."""
    shared = texts.sparkSession.sparkContext.broadcast(models)
    names = [*CLASSES, "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = Shown()
        for batch in batches:
            for b in slices(batch):
                shown.add(b.column("text").to_pylist(), b.column("weight").to_pylist(), shared.value)
        shown.close()
        table = np.zeros((len(names), BUCKETS + 1), np.float32)
        table[:-1, :BUCKETS], table[-1, :SHAPE_BUCKETS], table[-1, BUCKETS] = shown.letters, shown.shapes, shown.texts
        at = np.flatnonzero(table.any(axis=0))  # the weight of all texts goes as the last bucket
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(row[at]) for row in table)], ["bucket", *names])

    met = texts.mapInArrow(run, "bucket int, " + ", ".join(f"{n} float" for n in names))
    met = met.groupBy("bucket").agg(*[F.sum(n).cast("float").alias(n) for n in names]).toArrow()
    table = np.zeros((len(names), BUCKETS + 1), np.float32)
    for row, n in zip(table, names, strict=True):
        row[met.column("bucket").to_numpy()] = met.column(n).to_numpy()
    return models_of(Shown(table[:-1, :BUCKETS], table[-1, :SHAPE_BUCKETS], float(table[-1, BUCKETS])))


def judged_texts(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, n_notice, n_filler, n_prose, n_field, residue) of every text that is not null, empty or blank: characters by class.

    Each text is judged where it is read, in one pass over its whole length; rows without text are no cases."""
    shared = docs.sparkSession.sparkContext.broadcast(models or fit_on(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b for whole in batches for b in slices(whole)):
            got = judge_all(batch.column("text").to_pylist(), m)
            columns = [pa.array([getattr(v, a) for v in got], pa.int64()) for a in ("notice", "filler", "prose", "field_chars")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([is_residue(v) for v in got], pa.bool_())], ["doc_id", "n_notice", "n_filler", "n_prose", "n_field", "residue"])

    texts = with_text(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id bigint, n_notice bigint, n_filler bigint, n_prose bigint, n_field bigint, residue boolean")


def residue_docs(docs: DataFrame) -> DataFrame:
    """(doc_id), without repeats, of every text to exclude."""
    return judged_texts(docs).where("residue").select("doc_id").distinct()
