"""A table of word forms made from lemmas by the regular paradigms of six languages: morph(lang, form, pos, gender, number, person, lemma, kind).

``pos`` is noun, adjective or verb; ``kind`` tells a verb's forms apart (infinitive, present, subjunctive, participle, supine) and a noun's
cases. Irregular verbs are given by their forms. Callers add rows of their own (the rules' ``morphology`` option).
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

from .inflection import back, weak


class Form(NamedTuple):
    lang: str
    form: str
    pos: str
    gender: str = ""
    number: str = ""
    person: int = 0
    lemma: str = ""
    kind: str = ""


#: Nouns by language and gender, with the plural where it is not regular (fixed values).
NOUNS = {
    "de": {
        "m": "Hund/Hunde Tisch/Tische Mann/Männer Baum/Bäume Tag/Tage Brief/Briefe Stuhl/Stühle Weg/Wege Garten/Gärten Apfel/Äpfel Bahnhof/Bahnhöfe Berg/Berge Film/Filme Fluss/Flüsse Freund/Freunde Koffer/Koffer Kuchen/Kuchen Lehrer/Lehrer Mantel/Mäntel Monat/Monate Platz/Plätze Schlüssel/Schlüssel Sohn/Söhne Sommer/Sommer Vater/Väter Vogel/Vögel Wagen/Wagen Winter/Winter Zug/Züge",
        "f": "Frau/Frauen Katze/Katzen Lampe/Lampen Stadt/Städte Schule/Schulen Tür/Türen Straße/Straßen Woche/Wochen Antwort/Antworten Arbeit/Arbeiten Blume/Blumen Brücke/Brücken Farbe/Farben Firma/Firmen Frage/Fragen Geschichte/Geschichten Hand/Hände Kirche/Kirchen Küche/Küchen Mutter/Mütter Nacht/Nächte Reise/Reisen Schwester/Schwestern Sprache/Sprachen Tasche/Taschen Tochter/Töchter Uhr/Uhren Wohnung/Wohnungen Zeitung/Zeitungen",
        "n": "Haus/Häuser Kind/Kinder Buch/Bücher Auto/Autos Jahr/Jahre Fenster/Fenster Bild/Bilder Land/Länder Bett/Betten Dorf/Dörfer Ei/Eier Feld/Felder Geschäft/Geschäfte Geschenk/Geschenke Glas/Gläser Hemd/Hemden Kleid/Kleider Lied/Lieder Mädchen/Mädchen Meer/Meere Messer/Messer Pferd/Pferde Problem/Probleme Schiff/Schiffe Spiel/Spiele Tier/Tiere Wort/Wörter Zimmer/Zimmer",
    },
    "fr": {
        "m": "chien livre jardin garçon homme train jour problème mur arbre ami bateau/bateaux bois bras café cadeau/cadeaux chat chemin cheval/chevaux chapeau/chapeaux enfant frère fromage journal/journaux lit marché matin mois oiseau/oiseaux pain pays père pied sac soir soleil travail/travaux vélo village vin voyage",
        "f": "maison table voiture femme fille ville porte semaine idée amie année chaise chambre chanson clé couleur cuisine école église famille fenêtre fête fleur forêt gare langue lettre lumière main mer mère montagne musique nuit page plage pomme question rivière robe route rue sœur tasse valise vie",
    },
    "es": {
        "m": "perro libro coche niño día problema mapa árbol amigo año barco brazo café camino campo coro dinero edificio fuego gato hermano hijo hombre hotel jardín juego lápiz/lápices lugar mercado mes mundo ojo padre país pan papel parque pie plato precio pueblo río sol sueño tema tren viaje vino zapato",
        "f": "casa mesa ciudad mano mujer noche puerta semana amiga calle cama canción/canciones carta cocina cosa escuela estación/estaciones falda familia fiesta flor foto gata gente hermana hija historia hoja idea isla lengua llave luz/luces madre manzana montaña música niña palabra playa pregunta radio silla tarde tienda torre ventana vida voz/voces",
    },
    "pt": {
        "m": "livro carro menino dia problema mapa cão/cães homem/homens amigo ano barco braço café caminho campo dinheiro edifício filho fogo gato irmão/irmãos jardim/jardins jogo lápis/lápis lugar mar mercado mês/meses mundo olho pai país pão/pães papel/papéis parque pé prato preço quarto rio sol/sóis sonho tema vento vinho",
        "f": "casa mesa cidade mão/mãos mulher noite porta semana amiga bola cadeira cama canção/canções carta chave cozinha escola estação/estações estrada família festa filha flor folha foto gata história ideia ilha irmã janela língua loja luz mãe manhã montanha música palavra pergunta praia rua tarde torre vida voz",
    },
    "sv": {
        "u": "hund/hundar bil/bilar bok/böcker stol/stolar stad/städer dag/dagar katt/katter vecka/veckor affär/affärer båt/båtar cykel/cyklar dörr/dörrar flicka/flickor fågel/fåglar gata/gator kopp/koppar kvinna/kvinnor lampa/lampor mat natt/nätter pojke/pojkar resa/resor sjö/sjöar skog/skogar skola/skolor sommar/somrar tavla/tavlor tidning/tidningar vinter/vintrar väg/vägar väska/väskor hylla/hyllor verkstad/verkstäder gård/gårdar",
        "n": "hus barn bord år land/länder rum tåg brev arbete/arbeten berg bröd djur fönster glas golv hjärta/hjärtan kök kort ljus namn ord papper problem piano/pianon samtal skepp språk tak torg träd vin ägg äpple/äpplen",
    },
}
#: Adjectives in the form that the paradigm starts from (fixed values).
ADJECTIVES = {
    "fr": "petit grand vert noir blanc/blanche gris bleu content froid chaud haut court long/longue lourd fort mauvais méchant ouvert fermé cassé fatigué joli gros/grosse bas/basse doux/douce vieux/vieille beau/belle nouveau/nouvelle heureux/heureuse",
    "es": "pequeño rojo blanco nuevo viejo negro bueno malo alto bajo largo corto caro barato frío limpio sucio bonito feo rico cansado abierto cerrado roto tranquilo oscuro amarillo",
    "pt": "pequeno vermelho branco novo velho preto alto baixo longo curto caro barato frio limpo sujo bonito feio rico cansado aberto fechado quebrado tranquilo escuro amarelo",
    "sv": "stor/stort liten/litet röd/rött gammal/gammalt ny/nytt fin/fint dyr/dyrt grön/grönt kall/kallt varm/varmt snabb/snabbt lång/långt kort/kort ung/ungt svår/svårt vacker/vackert trött/trött hög/högt låg/lågt stark/starkt vit/vitt blå/blått god/gott ren/rent tung/tungt",
}
#: Regular verbs by their infinitive (fixed values).
VERBS = {
    "de": "machen sagen fragen spielen kaufen lernen leben suchen brauchen holen zeigen glauben hören kochen wohnen lachen weinen tanzen malen bauen danken legen stellen lieben passen planen schicken arbeiten antworten warten baden reden kosten",
    "fr": "parler donner trouver penser aimer chercher demander jouer marcher porter regarder rester montrer passer travailler écouter chanter danser fermer gagner habiter laver laisser oublier préparer quitter raconter rencontrer tomber tourner visiter finir choisir grandir réussir remplir",
    "es": "hablar trabajar comprar mirar llamar esperar llegar ayudar buscar cantar caminar cocinar estudiar ganar llevar necesitar pagar preguntar tomar viajar visitar usar comer beber vender aprender correr leer comprender vivir escribir abrir subir recibir decidir",
    "pt": "falar trabalhar comprar olhar chamar esperar chegar ajudar buscar cantar caminhar cozinhar estudar ganhar levar precisar pagar perguntar tomar viajar visitar usar comer beber vender aprender correr compreender partir abrir decidir assistir",
    "sv": "prata arbeta spela titta jobba hoppa tala fråga svara vänta börja sluta handla laga dansa baka städa hämta öppna lyssna",
}
#: Verbs by their forms: present by person (or the stem's changes), then participle or supine, subjunctive (fixed values).
IRREGULAR = {
    "de": {
        "sein": ("bin bist ist sind seid sind", "gewesen"), "haben": ("habe hast hat haben habt haben", "gehabt"), "gehen": ("gehe gehst geht gehen geht gehen", "gegangen"), "kommen": ("komme kommst kommt kommen kommt kommen", "gekommen"),
        "sehen": ("sehe siehst sieht sehen seht sehen", "gesehen"), "schreiben": ("schreibe schreibst schreibt schreiben schreibt schreiben", "geschrieben"), "finden": ("finde findest findet finden findet finden", "gefunden"), "nehmen": ("nehme nimmst nimmt nehmen nehmt nehmen", "genommen"),
        "geben": ("gebe gibst gibt geben gebt geben", "gegeben"), "sprechen": ("spreche sprichst spricht sprechen sprecht sprechen", "gesprochen"), "lesen": ("lese liest liest lesen lest lesen", "gelesen"), "essen": ("esse isst isst essen esst essen", "gegessen"),
        "trinken": ("trinke trinkst trinkt trinken trinkt trinken", "getrunken"), "fahren": ("fahre fährst fährt fahren fahrt fahren", "gefahren"), "laufen": ("laufe läufst läuft laufen lauft laufen", "gelaufen"), "schlafen": ("schlafe schläfst schläft schlafen schlaft schlafen", "geschlafen"),
        "helfen": ("helfe hilfst hilft helfen helft helfen", "geholfen"), "bleiben": ("bleibe bleibst bleibt bleiben bleibt bleiben", "geblieben"), "werden": ("werde wirst wird werden werdet werden", "geworden"), "wissen": ("weiß weißt weiß wissen wisst wissen", "gewusst"),
    },
    "fr": {
        "être": ("suis es est sommes êtes sont", "été", "soit"), "avoir": ("ai as a avons avez ont", "eu", "ait"), "aller": ("vais vas va allons allez vont", "allé", "aille"), "faire": ("fais fais fait faisons faites font", "fait", "fasse"),
        "venir": ("viens viens vient venons venez viennent", "venu", "vienne"), "pouvoir": ("peux peux peut pouvons pouvez peuvent", "pu", "puisse"), "vouloir": ("veux veux veut voulons voulez veulent", "voulu", "veuille"), "savoir": ("sais sais sait savons savez savent", "su", "sache"),
        "manger": ("mange manges mange mangeons mangez mangent", "mangé", "mange"), "commencer": ("commence commences commence commençons commencez commencent", "commencé", "commence"), "acheter": ("achète achètes achète achetons achetez achètent", "acheté", "achète"),
        "prendre": ("prends prends prend prenons prenez prennent", "pris", "prenne"), "dire": ("dis dis dit disons dites disent", "dit", "dise"), "voir": ("vois vois voit voyons voyez voient", "vu", "voie"), "mettre": ("mets mets met mettons mettez mettent", "mis", "mette"),
    },
    "es": {
        "ser": ("soy eres es somos sois son", "sido", "sea"), "estar": ("estoy estás está estamos estáis están", "estado", "esté"), "tener": ("tengo tienes tiene tenemos tenéis tienen", "tenido", "tenga"), "ir": ("voy vas va vamos vais van", "ido", "vaya"),
        "hacer": ("hago haces hace hacemos hacéis hacen", "hecho", "haga"), "venir": ("vengo vienes viene venimos venís vienen", "venido", "venga"), "poder": ("puedo puedes puede podemos podéis pueden", "podido", "pueda"), "querer": ("quiero quieres quiere queremos queréis quieren", "querido", "quiera"),
        "decir": ("digo dices dice decimos decís dicen", "dicho", "diga"), "saber": ("sé sabes sabe sabemos sabéis saben", "sabido", "sepa"), "ver": ("veo ves ve vemos veis ven", "visto", "vea"), "poner": ("pongo pones pone ponemos ponéis ponen", "puesto", "ponga"),
    },
    "pt": {
        "ser": ("sou és é somos sois são", "sido", "seja"), "estar": ("estou estás está estamos estais estão", "estado", "esteja"), "ter": ("tenho tens tem temos tendes têm", "tido", "tenha"), "ir": ("vou vais vai vamos ides vão", "ido", "vá"),
        "fazer": ("faço fazes faz fazemos fazeis fazem", "feito", "faça"), "vir": ("venho vens vem vimos vindes vêm", "vindo", "venha"), "poder": ("posso podes pode podemos podeis podem", "podido", "possa"), "querer": ("quero queres quer queremos quereis querem", "querido", "queira"),
        "dizer": ("digo dizes diz dizemos dizeis dizem", "dito", "diga"), "saber": ("sei sabes sabe sabemos sabeis sabem", "sabido", "saiba"), "ver": ("vejo vês vê vemos vedes veem", "visto", "veja"),
    },
}
#: Swedish verbs that are not regular: infinitive, present, supine, participle (fixed values).
SWEDISH = "skriva/skriver/skrivit/skriven finna/finner/funnit/funnen springa/springer/sprungit/sprungen dricka/dricker/druckit/drucken läsa/läser/läst/läst köpa/köper/köpt/köpt äta/äter/ätit/äten sova/sover/sovit/ ta/tar/tagit/tagen ge/ger/gett/given se/ser/sett/sedd stjäla/stjäl/stulit/stulen bryta/bryter/brutit/bruten bjuda/bjuder/bjudit/bjuden binda/binder/bundit/bunden sjunga/sjunger/sjungit/sjungen vinna/vinner/vunnit/vunnen bära/bär/burit/buren"
#: Finnish nouns, and verbs by first person, third person, third person plural (fixed values).
FINNISH_NOUNS = "kahvi musiikki kirja auto talo koulu kauppa katu kaupunki metsä järvi koti pallo peli kukka tyttö poika koira kissa ruoka juoma elokuva laulu tanssi matka kesä talvi juna laiva torni puisto ranta saari silta kenttä hotelli ravintola museo kirkko tehdas"
FINNISH_VERBS = "olen/on/ovat menen/menee/menevät tulen/tulee/tulevat asun/asuu/asuvat puhun/puhuu/puhuvat istun/istuu/istuvat luen/lukee/lukevat kerron/kertoo/kertovat syön/syö/syövät juon/juo/juovat teen/tekee/tekevät näen/näkee/näkevät saan/saa/saavat ostan/ostaa/ostavat haluan/haluaa/haluavat tiedän/tietää/tietävät kysyn/kysyy/kysyvät nukun/nukkuu/nukkuvat juoksen/juoksee/juoksevat laulan/laulaa/laulavat"
#: Endings of regular verbs: present by person, participle, subjunctive.
ENDINGS = {
    ("fr", "er"): ("e es e ons ez ent", "é", "e"), ("fr", "ir"): ("is is it issons issez issent", "i", "isse"),
    ("es", "ar"): ("o as a amos áis an", "ado", "e"), ("es", "er"): ("o es e emos éis en", "ido", "a"), ("es", "ir"): ("o es e imos ís en", "ido", "a"),
    ("pt", "ar"): ("o as a amos ais am", "ado", "e"), ("pt", "er"): ("o es e emos eis em", "ido", "a"), ("pt", "ir"): ("o es e imos is em", "ido", "a"),
}
PERSONS = ((1, "s"), (2, "s"), (3, "s"), (1, "p"), (2, "p"), (3, "p"))
#: Participles that are not built by rule (fixed values).
PARTICIPLES = {"es": {"escribir": "escrito", "abrir": "abierto", "leer": "leído"}, "pt": {"abrir": "aberto", "ganhar": "ganho", "pagar": "pago"}}


def _plural(lang: str, noun: str) -> str:
    if lang == "fr":
        return noun if noun[-1] in "sxz" else noun + "s"
    if lang in ("es", "pt"):
        return noun + ("s" if noun[-1] in "aeiouéáíóúã" else "es")
    return noun


def _adjective(lang: str, entry: str):
    one, _, two = entry.partition("/")
    if lang == "sv":
        yield from ((one, "u", "s"), (two, "n", "s"))
    elif lang == "fr":
        two = two or one + ("" if one.endswith("e") else "e")
        yield from ((one, "m", "s"), (two, "f", "s"), (one if one[-1] in "sx" else one + ("x" if one.endswith("eau") else "s"), "m", "p"), (two + "s", "f", "p"))
    else:
        yield from ((one, "m", "s"), (one[:-1] + "a", "f", "s"), (one + "s", "m", "p"), (one[:-1] + "as", "f", "p"))


def _german(verb: str):
    stem = verb.removesuffix("en")
    e = "e" if stem[-1] in "td" else ""
    s = "" if stem[-1] in "sßxz" else "s"
    return f"{stem}e {stem}{e}{s}t {stem}{e}t {verb} {stem}{e}t {verb}", f"ge{stem}{e}t"


def _rows():
    for lang, by_gender in NOUNS.items():
        for gender, nouns in by_gender.items():
            for entry in nouns.split():
                one, _, many = entry.partition("/")
                yield Form(lang, one, "noun", gender, "s", lemma=one)
                yield Form(lang, many or _plural(lang, one), "noun", gender, "p", lemma=one)
    for lang, own in ADJECTIVES.items():
        for entry in own.split():
            for form, gender, number in _adjective(lang, entry):
                yield Form(lang, form, "adjective", gender, number, lemma=entry.partition("/")[0])
    verbs: list[tuple[str, str, str, str, str]] = []
    for lang, own in VERBS.items():
        for verb in own.split():
            if lang == "de":
                verbs.append((lang, verb, *_german(verb), ""))
            elif lang == "sv":
                yield from (Form(lang, verb, "verb", lemma=verb, kind="infinitive"), Form(lang, verb + "r", "verb", lemma=verb, kind="present"), Form(lang, verb + "t", "verb", lemma=verb, kind="supine"), Form(lang, verb + "d", "verb", lemma=verb, kind="participle"))
            else:
                present, participle, subjunctive = ENDINGS[lang, verb[-2:]]
                stem = verb[:-2]
                soft = stem[:-1] + {"c": "qu", "g": "gu", "z": "c"}.get(stem[-1], stem[-1]) if verb.endswith("ar") else stem
                verbs.append((lang, verb, " ".join(stem + x for x in present.split()), PARTICIPLES.get(lang, {}).get(verb, stem + participle), soft + subjunctive))
    for lang, own in IRREGULAR.items():
        verbs += [(lang, verb, *forms, *[""] * (3 - len(forms)))[:5] for verb, forms in own.items()]
    for lang, verb, present, participle, subjunctive in verbs:
        yield Form(lang, verb, "verb", lemma=verb, kind="infinitive")
        for (person, number), form in zip(PERSONS, present.split(), strict=True):
            yield Form(lang, form, "verb", "", number, person, verb, "present")
        yield Form(lang, participle, "verb", lemma=verb, kind="participle")
        if subjunctive:
            yield Form(lang, subjunctive, "verb", "", "s", 3, verb, "subjunctive")
    for entry in SWEDISH.split():
        verb, present, supine, participle = entry.split("/")
        for form, kind in ((verb, "infinitive"), (present, "present"), (supine, "supine"), (participle, "participle")):
            if form:
                yield Form("sv", form, "verb", lemma=verb, kind=kind)
        if participle.endswith("en"):
            yield from (Form("sv", participle[:-1] + "t", "verb", lemma=verb, kind="participle"), Form("sv", participle[:-2] + "na", "verb", lemma=verb, kind="participle"))
    for noun in FINNISH_NOUNS.split():
        a = "a" if back(noun) else "ä"
        soft, strong = weak(noun) or noun, noun
        if noun in ("järvi", "talvi"):
            soft = strong = noun[:-1] + "e"
        for kind, form in (("nominative", noun), ("elative", soft + "st" + a), ("inessive", soft + "ss" + a), ("illative", strong + strong[-1] + "n")):
            yield Form("fi", form, "noun", number="s", lemma=noun, kind=kind)
    for entry in FINNISH_VERBS.split():
        one, third, many = entry.split("/")
        for (person, number), form in zip(PERSONS, (one, one[:-1] + "t", third, one[:-1] + "mme", one[:-1] + "tte", many), strict=True):
            yield Form("fi", form, "verb", "", number, person, one, "present")


@lru_cache(maxsize=1)
def table() -> tuple[Form, ...]:
    """All rows, each once."""
    return tuple(dict.fromkeys(_rows()))


class Lexicon:
    """The rows of one language by form and by lemma, with a caller's rows added.

    ``extra`` rows are (lang, form, pos, gender, number, person, lemma, kind), shorter ones filled up, or (lang, noun, gender).
    """

    def __init__(self, lang: str, extra=()):
        own = [f for f in table() if f.lang == lang]
        for row in extra:
            if row[0] == lang:
                own.append(Form(lang, row[1], "noun", row[2], "s", lemma=row[1]) if len(row) == 3 else Form(*row))
        self.by_form: dict[str, list[Form]] = defaultdict(list)
        self.by_lemma: dict[str, list[Form]] = defaultdict(list)
        for f in own:
            self.by_form[f.form].append(f)
            self.by_lemma[f.lemma].append(f)

    def of(self, form: str, pos: str, **wanted) -> list[Form]:
        found = self.by_form.get(form) or (self.by_form.get(form.lower()) if pos != "noun" or form[:1].isupper() else None) or ()
        return [f for f in found if f.pos == pos and all(getattr(f, k) == v for k, v in wanted.items())]

    def form(self, lemma: str, pos: str, **wanted) -> str | None:
        return next((f.form for f in self.by_lemma.get(lemma, ()) if f.pos == pos and all(getattr(f, k) == v for k, v in wanted.items())), None)


@lru_cache(maxsize=64)
def lexicon(lang: str, extra: tuple = ()) -> Lexicon:
    return Lexicon(lang, extra)


def words(lang: str, pos: str, extra: tuple = (), **wanted) -> str:
    """An alternation of all forms of a kind, for a pattern."""
    own = {f.form for fs in lexicon(lang, extra).by_form.values() for f in fs if f.pos == pos and all(getattr(f, k) == v for k, v in wanted.items())}
    return "|".join(sorted(map(re.escape, own), key=len, reverse=True))
