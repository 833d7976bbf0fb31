"""Languages by hashed character n-grams, and lists of their common words."""

from __future__ import annotations

import unicodedata

import numpy as np

from .spans import _mix, _Powers

# Article 1 of the Universal Declaration of Human Rights (fixed values).
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "ja": "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
}

# Common words by language, the shortest of the usual stop lists (fixed values).
STOPS = {
    "en": "a about after all also an and any are as at be because been before both but by can could did do does during each even for from had has have he her his how if in into is it its like many may more most no not now of on one only or other our out over part she since so some such than that the their them then there these they this though through time to two under up was we were what when where which while who will with would you your near between whether whose cf",
    "de": "aber als am an auch auf aus bei bis da damit dann das dass dem den der des die dies doch durch ein eine einem einen einer es für hat ich ihr im in ist ja jede kann kein mehr mit nach nicht noch nun nur ob obwohl oder ohne sehr sein seine sich sie sind so über um und uns unter vom von vor war waren was weil wenn werden wie wir wird wo wurde wurden zu zum zur zwischen",
    "fr": "alors au aucun aux avec bien car ce cela ces cette comme d dans de des dès deux donc du elle en entre est et été être fait il ils je l la le les leur lui mais même n ne nous on ont ou où par pas peu plus pour qu quand que qui s sa sans se selon ses si son sont sous sur tandis tout très un une vers vous y",
    "es": "al algo ante antes como con contra cuando de del desde donde dos durante e el ella ellos en entre era es esta este fue ha hasta hay la las le les lo los mientras más me mi muy nada ni no nos o otra otro para pero poco por porque que quien se según ser si sin sobre son su sus también tan un una uno y ya yo",
    "it": "a ad ai al alla alle anche c che chi ci come con cui da dal dalla dei del della delle di dove e è ed era fra gli ha hanno i il in io l la le lo loro ma mentre nel nella non o per perché più quando questa questo se si sono su sua sul suo tra tutti un una uno",
    "pt": "a ao aos as até com como da das de do dos e é ela ele em entre era essa este eu foi há isso já mais mas na nas não nem no nos num o os ou para pela pelo por quando que quem se sem ser seu são sua também tem um uma",
    "nl": "aan al als bij dan dat de der deze die dit door een en er geen had heb heeft het hij ik in is ja je kan maar meer met mijn naar niet nog nu of om omdat onder ook op over te tot uit van veel voor was wat we werd wie wordt zich zij zijn zo zou",
    "sv": "att av de den det där du efter eller en ett från för ha hade han har hon i in inte ja jag kan man med men mot mycket när nu och om på sig sin ska som så till under upp ut var vi vid är över",
    "da": "af alle at blev da de den der det du efter eller en er et for fra ham han har havde hun hvor i ikke ind jeg kan man med meget men mod når nu og også om op over på sig skal som så til ud var ved vi vil være",
    "fi": "ei eivät ennen että he hän ja joka jos jotka kanssa koska kuin kun me mikä minä mukaan mutta myös ne niin nyt olen oli olivat on ovat se sekä sen siellä sitä tai tämä vaan vaikka vielä voi ilman jo",
    "pl": "a aby ale bez bo bardzo był była było być co czy dla do gdy gdzie go i ich ja jak jako je jego jej jest już ku lub ma może na nad nie niż o od on ona oraz po pod przed przez przy są się ta tak tam te tego tej ten też to w we więc z za ze że",
    "cs": "a aby ale ani bez bude byl byla bylo být co do i já jak jako je jeho jen ještě již k kde kdy který která když ke ma mezi na nad ne nebo není o od on po pod pro před při s se si tak také to toto v ve však z za ze že",
    "hu": "a az azt be de egy el és ez ha hanem hogy hogyan is ki kell le már más meg még mert mint most nagyon nem ne össze pedig sem szerint talán után vagy van vissza volt volna voltak",
    "ro": "a ai al ale am au ca că care cât ce cel cu cum da dar de din doar după ea el este eu fi fost în înainte ei la le lui mai nu o pe pentru prin sa sau se și sunt un una unde unei unui va",
    "tr": "ama ancak bazı bile bir biri biz bu bunu çok çünkü da daha de değil diye en gibi göre hem her hiç için idi ile ise kadar ki kim mi mu nasıl ne neden o olan olarak oldu olduğu onun sonra şu tüm üzere var ve veya ya yani",
    "id": "ada adalah agar akan aku antara apa atau bagi bahwa banyak belum bisa dalam dan dapat dari di dia hanya harus ia ini itu jika juga karena ke kita lain lebih maka mereka oleh orang pada saat saya sebagai secara sudah tak telah tersebut tidak untuk yang",
    "ru": "а без бы был была были было быть в вам вас весь во вот все всё вы где да даже для до его ее если есть ещё же за и из или им их к как ко когда кто ли между меня мне мы на над не него нет ни но о об он она они от перед по под после потому почему при с со так также то тогда только том тот у уже чем что чтобы эта это этот я под",
    "uk": "а але б без би був була були бути в вже ви від він вона вони все для до з за зі і із й його її їх коли ли між ми на над не ні но о об один по при про та так також те ти то той тільки у хто це цей ця що щоб я як який якщо",
    "el": "αλλά αν από για δεν είναι εκεί ενώ ένα ένας επειδή η ήταν θα και κάθε κατά με μετά μέσα μη μια να ο οι όπως όταν ότι όχι πιο που προς πως σε στη στην στις στο στον στους στα τα τη την της τις το τον του τους των ως",
    "ar": "إذا إلى إن أن أو أي بعد بل بين بينما تلك ثم حتى حيث خلال ذلك على عن عند غير في قبل قد كان كانت كل كما لا لكن لم له لها ليس ما مع مما من منذ هذا هذه هل هو هي و التي الذي",
    "hi": "अपने अब आप इस इसके इसलिए उस एक और कई कर करने का कि किया की कुछ के को कोई क्या गया जब जबकि जो तक तथा तो था थी थे द्वारा दिया न नहीं ने पर फिर बाद भी में यह या ये रहा रही लिए वह वे से हुई हुए है हैं हो होता होने",
}
STOPS = {k: frozenset(v.split()) for k, v in STOPS.items()}

_MASKS: list[tuple[np.ndarray, np.ndarray]] = []


def text_hashes(texts: list[str]) -> np.ndarray:
    """Hashes of whole texts, as the running hashes of ``quality`` give them for words in lower case."""
    with np.errstate(over="ignore"):
        out = []
        for t in texts:
            codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
            up, _ = _Powers.of(len(codes) + 1)
            out.append((_mix(codes.astype(np.uint64) + np.uint64(11)) * up[: len(codes)]).sum(dtype=np.uint64))
    return np.array(out, dtype=np.uint64)


def stop_masks(hashes: np.ndarray) -> np.ndarray:
    """For each word's hash the languages whose lists have it, a bit each in the order of ``STOPS``."""
    if not _MASKS:
        words: dict[str, int] = {}
        for k, ws in enumerate(STOPS.values()):
            for w in ws:
                words[w] = words.get(w, 0) | 1 << k
        h = text_hashes(list(words))
        order = np.argsort(h)
        _MASKS.append((h[order], np.array(list(words.values()), dtype=np.uint32)[order]))
    known, masks = _MASKS[0]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, masks[at], np.uint32(0))


SCRIPTS = ("latin", "cyrillic", "greek", "arabic", "devanagari", "thai", "hangul", "kana", "han")
_SCRIPTS: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """The script of each letter of the basic plane, counted from 1 in the order of ``SCRIPTS``; 0 is none of them."""
    if not _SCRIPTS:
        table = np.zeros(0x10000, dtype=np.uint8)
        ranges = ((0x41, 0x250), (0x1E00, 0x1F00)), ((0x400, 0x530),), ((0x370, 0x400), (0x1F00, 0x2000)), ((0x600, 0x780),), ((0x900, 0x980),), ((0xE00, 0xE80),), ((0x1100, 0x1200), (0xAC00, 0xD7A4)), ((0x3040, 0x3100),), ((0x3400, 0xA000),)
        for k, of in enumerate(ranges, 1):
            for a, b in of:
                table[a:b] = k
        table[[c for c in range(0x10000) if not chr(c).isalpha()]] = 0
        _SCRIPTS.append(table)
    return _SCRIPTS[0]


WIDTH = 4096
SPACE = 0x20
_TABLES: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each character its letter in lower case, 0 where it cannot be seen, ``SPACE`` where it parts words."""
    if not _TABLES:
        table = np.full(0x10000, SPACE, dtype=np.uint32)
        for i in range(0x10000):
            c = chr(i)
            kind = unicodedata.category(c)
            if kind[0] in "LM":
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
            elif kind == "Cf":
                table[i] = 0
        _TABLES.append(table)
    return _TABLES[0]


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each ended by a line break, and the number of the text of each."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return codes, np.repeat(np.arange(len(texts)), sizes)


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed pairs and triples of characters, one row a text; the texts are read whole."""
    if not texts:
        return np.zeros((0, WIDTH), dtype=np.float32)
    codes, owner = joined_codes(texts)
    codes = letters()[np.minimum(codes, 0xFFFF)]
    space = codes == SPACE
    kept = codes != 0
    if not kept.all():
        codes, owner, space = codes[kept], owner[kept], space[kept]
    kept = ~space  # runs of what is no letter are one
    kept[1:] |= ~space[:-1] | (owner[1:] != owner[:-1])
    kept[:1] = True
    codes, owner = codes[kept], owner[kept]
    at = owner * WIDTH
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + codes[2:] * np.uint32(0x27D4EB2F)
    ids = np.concatenate([at[:-1] + (two >> np.uint32(20)), at[:-2] + (three >> np.uint32(20))])
    # those that run from one text into the next go to a place of their own
    over = np.flatnonzero(owner[1:] != owner[:-1])
    also = np.concatenate([over, over - 1])
    ids[over] = ids[len(two) + also[(also >= 0) & (also < len(three))]] = len(texts) * WIDTH
    return np.bincount(ids, minlength=len(texts) * WIDTH + 1)[:-1].astype(np.float32).reshape(len(texts), WIDTH)


class Profiles:
    """Languages as distributions of hashed character n-grams.

    They are learned from seeds and common words, and then from texts of the corpus, each counted for the language that
    it is most like.
    """

    def __init__(self, texts: list[str] = (), more: np.ndarray | None = None):
        """``more`` are the sums of ``told`` over texts, where these are too many to be given."""
        self.names = list(SEEDS)
        seeds = np.stack([gram_counts([t, " ".join(sorted(STOPS.get(k, ())))]).sum(0) for k, t in SEEDS.items()])
        self._set(seeds)
        if texts:
            more = self.told(gram_counts(list(texts)))
        if more is not None:
            # as much as the seeds' own tenfold, so that what a language is stays told by them
            more = more * (10 * seeds.sum(1, keepdims=True) / np.maximum(1.0, more.sum(1, keepdims=True)))
            self._set(seeds + more)

    def told(self, counts: np.ndarray) -> np.ndarray:
        """The counts of texts, a row each, summed by the language that each is most like."""
        sums = np.zeros((len(self.names), WIDTH), dtype=np.float32)
        np.add.at(sums, self.evidence(counts).argmax(1), counts)
        return sums

    def _set(self, counts: np.ndarray) -> None:
        smooth = counts + 0.05
        self.logs = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    def evidence(self, counts: np.ndarray) -> np.ndarray:
        """Mean log-likelihood of each language, a row a text."""
        return (counts @ self.logs.T) / np.maximum(1.0, counts.sum(1, keepdims=True))
