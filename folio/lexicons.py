"""Word lists, patterns, limits and texts that results depend on."""

import unicodedata

# Line patterns of text files; two matching lines make a book of chapters.
SECTION_MARKERS = [
    r"(?iu)^\s*(chapter|capítulo|chapitre|kapitel)\s+[\divxlc]+",
    r"(?iu)^\s*(chapter|capítulo)\s+[\p{L}\p{N}_]+",
    r"(?iu)^\s*[\divxlc]{1,6}[\.\-\)]\s",
    r"^\s*\*{3,}\s*$",
    r"^\s*-{3,}\s*$",
    r"^\s*#{1,3}\s+[\p{L}\p{N}_]",
]
# Patterns of a stripped line that begins a chapter, a scene, a point of view.
CHAPTER = [
    r"(?iu)^cap[ií]tulo\s+[\dIVXLCivxlc]+",
    r"(?iu)^chapter\s+[\dIVXLCivxlc]+",
    r"^第[一二三四五六七八九十百千]+章",
    r"^#{1,2}\s+.+",
    r"(?iu)^part\s+[\dIVXLCivxlc]+",
    r"(?iu)^[IVXLCivxlc]{1,6}\.$",
]
SCENE = [r"^[*\-—]{3,}$", r"^[*\-—]\s*[*\-—]\s*[*\-—]$", r"^·{3,}$", r"^#{3,}$"]
POINT_OF_VIEW = [r"^\*{1,2}[A-ZÁÉÍÓÚ][^*]+\*{1,2}$", r"^[A-ZÁÉÍÓÚ]{2,}[^.!?]*$"]
PDF_CHAPTER = r"(?iu)^\s*(cap[ií]tulo|chapter|parte|part|prologue|pr[oó]logo)\s*[\divxlc]*"

NAME = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,}"
SPEECH = "dijo dijeron pregunto preguntó respondio respondió grito gritó susurro susurró murmuro murmuró exclamo exclamó anadio añadió".split()
ACTION = "miro miró sonrio sonrió asintio asintió avanzo avanzó ataco atacó corrio corrió rio rió penso pensó ordeno ordenó entro entró salio salió".split()
TITLES = "senor senora sr sra sir lady lord rey reina principe princesa general capitan doctor doctora".split()
GENITIVE = ["de", "del"]
NOT_NAMES = (
    "el la los las un una de del al en por para con sin ella ellas ello ellos eso esto esta este antes despues"
    " cuando mientras aunque porque pero como que entonces asi todavia bueno luego ahora estaba era fue es son eres estas escuche senor"
    " sala control centro verdad cualquiera demonio guardianes guardian guerreros guerrero soldados soldado angeles angel generales lideres ejercito ejercitos"
    " doce siete tres diez cinco seis ocho nueve once kufufufu jajaja jejeje hahaha texto original chunk capitulo pagina regreso estrella dragon slime demon"
    " lord king queen emperor master the that this time got from with when then they them their there have been will would could which what where who how some"
    " all one two him her his she was were had has may also even only than more very too out back being said still again most other into over after before"
    " about just your our and but not any new see its for are reincarnated"
).split()
#: Single words that are no character's name.
NO_CHARACTER = (
    "el la los las un una unos unas yo tu mi mis me nos nosotros nosotras ella ellas ello ellos eso esto esa ese esas esos aqui alli"
    " antes despues estaba estaban era eran fue fueron es son texto original chunk capitulo"
).split()


def _unmarked() -> tuple[str, str]:
    """Signs whose compatibility decomposition is one sign with combining marks, and that sign; then marks alone, which go."""
    marked = {}
    for sign in map(chr, range(0x80, 0x2000)):
        left = [c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c)]
        if len(left) == 1 and left[0] != sign:
            marked[sign] = left[0]
    marks = "".join(c for c in map(chr, range(0x300, 0x2000)) if unicodedata.combining(c))
    return "".join(marked) + marks, "".join(marked.values())


#: Accented letters and what they fold to.
ACCENTED, PLAIN = _unmarked()

GENERIC = "personaje mencionado en esta escena"
DEFAULT_VOICE = "narrador en tercera persona, tiempo pasado"
FIRST_PERSON = [" yo ", " me ", " mi ", " mí ", " conmigo ", " nosotros ", " nos "]
THIRD_PERSON = [" él ", " ella ", " ellos ", " ellas ", " le ", " les ", " su ", " sus "]
PAST = "fue era estaba había dijo pensó miró entró".split()
PRESENT = "es está dice piensa mira entra hay".split()
STYLE_KEYWORDS = [
    "mantener", "preservar", "adaptar", "traducir", "estilo", "tono", "registro", "consistencia", "voz", "narrador", "tiempo verbal", "perspectiva",
    "tutear", "ustedear", "nombre propio", "término",
]
GATE_KEYWORDS = ["nuevo", "new", "término", "term", "personaje", "character", "nombre", "name", "decisión", "decision"]
NO_NOTES = "Sin notas."
NO_SCENE = "Sin contenido suficiente para resumir la escena."
EMPTY = "[VACÍO]"
REVIEW_MARKER = "[⚠ PENDIENTE DE REVISIÓN]\n"
EXTRACT_EVERY = 5
#: In the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…")]

MOST_GLOSSARY, MOST_CHARACTERS, MOST_DECISIONS, MOST_SCENE_CHARS, MOST_DECISION_CHARS = 600, 240, 18, 420, 220
PROMPT_DECISIONS, PROMPT_SCENE_CHARS, DIGEST_CHARS = 8, 320, 280
SURE, SIMILAR = 0.75, 0.84
EXTENSIONS = (".epub", ".txt", ".md", ".pdf")
