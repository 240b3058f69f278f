"""Word lists and dictionaries of the domain. All of them are fixed values that results depend on."""

from __future__ import annotations

# Political terms, in the order in which the alternation tries them.
POLITICAL_LEXICON = [
    "ministro", "ministra", "diputado", "diputada", "senador", "senadora",
    "presidente", "presidenta", "vicepresidente", "gobernador", "gobernadora",
    "alcalde", "alcaldesa", "concejal", "subsecretario", "subsecretaria",
    "intendente", "seremi", "secretario de estado",
    "senado", "cámara de diputados", "congreso nacional", "congreso",
    "tribunal constitucional", "contraloría", "banco central",
    "palacio de la moneda", "la moneda", "gobierno de chile",
    "ministerio de hacienda", "ministerio del interior",
    "udi", "renovación nacional", "partido socialista", "partido comunista",
    "frente amplio", "democracia cristiana", "evópoli", "partido republicano",
    "apruebo dignidad", "la concertación", "nueva mayoría", "chile vamos",
    "plebiscito", "elecciones presidenciales", "elección presidencial",
    "segunda vuelta", "campaña presidencial", "constitución política",
    "convención constitucional", "proceso constituyente",
    "acusación constitucional", "interpelación", "proyecto de ley",
    "moción parlamentaria", "veto presidencial", "votación en sala",
    "comisión de hacienda", "comisión mixta",
    "estallido social", "18 de octubre", "reforma tributaria",
    "reforma de pensiones", "apruebo", "rechazo",
    "consejo constitucional", "comisión experta", "consejero constitucional",
    "consejera constitucional", "anteproyecto constitucional", "partido de la gente",
    "amarillos por chile", "servel", "ministerio de seguridad pública",
    "concertación", "reforma educacional", "gratuidad", "asamblea constituyente",
]

# Names that stand for an office rather than an actor. The signed analysis leaves out one more.
GENERIC_ACTORS = [
    "ejecutivo", "presidente", "estado", "estado de chile", "oposición", "oficialismo",
    "mandatario", "acuerdo", "chile", "plebiscito", "apruebo", "presidente de la república",
    "gobierno", "parlamento", "congreso nacional",
]
GENERIC_ACTORS_SIGNED = [*GENERIC_ACTORS, "gobierno de chile"]

# Acronyms and the full names they stand for, both normalised.
ACRONYMS = {
    "udi": "union democrata independiente",
    "rn": "renovacion nacional",
    "dc": "democracia cristiana",
    "pdc": "democracia cristiana",
    "ps": "partido socialista",
    "ppd": "partido por la democracia",
    "pc": "partido comunista de chile",
    "pcch": "partido comunista de chile",
    "rd": "revolucion democratica",
    "fa": "frente amplio",
    "prsd": "partido radical socialdemocrata",
    "frvs": "federacion regionalista verde social",
    "cs": "convergencia social",
}

# Known blocs by lower-cased canonical name.
BLOCS = {
    "DERECHA": ["sebastián piñera", "josé antonio kast", "unión demócrata independiente", "renovación nacional", "evópoli", "sebastián sichel", "evelyn matthei", "mario desbordes", "ignacio briones", "joaquín lavín", "manuel josé ossandón", "partido republicano", "chile vamos", "andrés allamand", "víctor pérez"],
    "APRUEBO_DIGNIDAD": ["gabriel boric font", "daniel jadue", "camila vallejo", "frente amplio", "partido comunista de chile", "revolución democrática", "convergencia social", "apruebo dignidad", "izkia siches", "giorgio jackson"],
    "EX_CONCERTACION": ["democracia cristiana", "partido socialista", "partido por la democracia", "yasna provoste", "carolina tohá", "michelle bachelet", "paula narváez", "álvaro elizalde"],
}

# Labels of the mention tagger and the node types they stand for.
MENTION_LABELS = {
    "persona": "person",
    "partido político": "party",
    "institución pública": "institution",
    "coalición política": "coalition",
    "pacto electoral": "coalition",
    "alianza política": "coalition",
    "movimiento social": "movement",
    "movimiento ciudadano": "movement",
    "organización": "org",
}

# Months of known events.
EVENTS = {"2019-10": "ESTALLIDO", "2020-10": "PLEBISCITO", "2021-12": "2da vuelta", "2022-09": "RECHAZO"}

# Words left out of topic keywords.
STOPWORDS = [
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las",
    "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como",
    "más", "pero", "sus", "le", "ya", "o", "este", "sí", "porque", "esta",
    "entre", "cuando", "muy", "sin", "sobre", "también", "me", "hasta",
    "hay", "donde", "quien", "desde", "todo", "nos", "durante", "todos",
    "uno", "les", "ni", "contra", "otros", "ese", "eso", "ante", "ellos",
    "e", "esto", "mí", "antes", "algunos", "qué", "unos", "yo", "otro",
    "otras", "era", "ha", "han", "fue", "ser", "dijo",
    "señaló", "indicó", "agregó", "explicó", "aseguró", "afirmó",
]


def political_lexicon(extra: list[str] | None = None) -> list[str]:
    """The terms, then extra ones in lower case that aren't among them."""
    return list(dict.fromkeys([*POLITICAL_LEXICON, *(t.lower().strip() for t in extra or [] if t.strip())]))
