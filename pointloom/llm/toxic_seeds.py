"""Training text of the tagger: word lists and frames of abuse, and frames of neutral text with the same words.

Written from general knowledge of the languages, without the test tables.  In a
frame ``{N}`` and the like take a word of that list of the frame's language, and
``a|b`` is either of the two words.
"""

# Words by language and kind.  N insults for a person, A contemptuous adjectives, B what groups are degraded to,
# G groups (the last of them invented), V infinitives of violence, P parts of the body, X sexual parts, S sexual verbs, C coarse words.
LISTS = {
    "en": {
        "N": "idiot moron imbecile cretin fool bastard asshole arsehole jerk loser scumbag wanker dickhead dumbass dimwit halfwit dunce clown liar coward "
        "crook fraud swine pig dog bitch slut whore cow hag worm rat toad maggot weasel parasite prick twat cunt tosser pervert lunatic psycho retard freak "
        "simpleton blockhead numbskull nitwit buffoon ignoramus scoundrel traitor motherfucker fucker shithead douchebag sucker disgrace failure creep leech "
        "cockroach vermin scum garbage trash filth",
        "A": "stupid dumb ugly pathetic worthless useless miserable filthy dirty disgusting brainless ignorant lazy fat stinking rotten lying spineless "
        "clueless incompetent fucking damn bloody goddamn sick slimy revolting despicable vile repulsive braindead moronic idiotic retarded wretched hopeless "
        "arrogant gutless brazen sleazy sorry shitty crappy lousy degenerate",
        "B": "vermin parasites rats animals scum filth trash cockroaches pigs subhumans savages criminals thieves rapists liars a_plague a_disease a_cancer monkeys apes "
        "leeches degenerates a_burden inferior worthless lazy dirty stupid retarded diseased barbarians garbage subhuman evil dogs a_stain",
        "G": "foreigners immigrants refugees migrants women men gays lesbians homosexuals jews muslims christians blacks whites arabs gypsies asians africans "
        "mexicans disabled cripples old_people poor_people girls infidels blondes northerners southerners transsexuals Zorvians Altrukans Mirenians Dorvish Quentari",
        "V": "kill beat strangle stab shoot murder hurt burn choke crush smash bury drown slaughter destroy gut hang punch rape poison torture butcher skin",
        "P": "face head neck throat legs arms bones teeth skull hands fingers nose ribs guts eyes kneecaps jaw",
        "X": "cock dick pussy cunt tits ass clit penis nipples boobs balls butt vagina breasts dildo asshole anus",
        "S": "fuck fucked fucking suck sucked sucking lick licked licking ride bang screw thrust pounded stroked rubbed fingered jerk masturbated penetrated blow spank deepthroat rimmed",
        "C": "fuck shit crap piss hell ass bollocks bullshit fucker arse damn wtf stfu",
    },
    "de": {
        "N": "Idiot Trottel Depp Vollidiot Arschloch Wichser Hurensohn Schwein Drecksau Mistkerl Dummkopf Blödmann Versager Lügner Penner Spasti Schlampe Hure "
        "Fotze Nutte Sau Kuh Ratte Hund Affe Esel Vollpfosten Schwachkopf Hohlkopf Drecksack Bastard Missgeburt Abschaum Wicht Lump Schuft Feigling Verräter "
        "Betrüger Ziege Zicke Schlappschwanz Spinner Kretin Scheißkerl Pisser Flasche Niete Weichei Luder Miststück Taugenichts Stümper Nichtsnutz Fettsack Dreckstück",
        "A": "dumme blöde hässliche dreckige elende verdammte verfickte widerliche stinkende fette faule feige verlogene erbärmliche hirnlose unfähige armselige "
        "beschissene dämliche ekelhafte miese nutzlose wertlose idiotische schwachsinnige verblödete jämmerliche blödes dummer blöder verdammter dreckiges",
        "B": "Ungeziefer Parasiten Ratten Abschaum Tiere Untermenschen Schmarotzer Verbrecher Diebe Gesindel Pack Schweine Affen Dreck Pest Krebsgeschwür "
        "minderwertig Kakerlaken Barbaren dumm faul dreckig Viehzeug Müll Kriminelle Wilde Schädlinge",
        "G": "Ausländer Flüchtlinge Frauen Weiber Männer Schwule Lesben Juden Muslime Türken Araber Schwarze Zigeuner Asylanten Behinderte Krüppel Migranten "
        "Polen Alte Homosexuelle Neger Kanaken Obdachlose Ungläubige Zorvier Altruken Mirener Dorvaner",
        "V": "töten schlagen verprügeln erwürgen abstechen erschießen umbringen verbrennen zerquetschen vergraben ertränken abschlachten vernichten aufhängen foltern vergiften zertreten",
        "P": "Gesicht Kopf Hals Kehle Beine Arme Knochen Zähne Schädel Hände Finger Nase Rippen Augen Fresse Kiefer",
        "X": "Schwanz Muschi Fotze Titten Arsch Möse Brüste Nippel Eier Kitzler Penis Hintern Pimmel Scheide Ständer",
        "S": "ficken fickte gefickt lutschen lutschte lecken leckte blasen vögeln vögelte wichsen stöhnte rammelte bumsen spritzte befriedigte stieß poppen fingerte",
        "C": "Scheiße Arsch verdammt Fick verpiss Fresse Maul Kacke Mist Dreck",
    },
    "fr": {
        "N": "idiot imbécile crétin connard abruti salaud salope con conne enculé ordure bâtard porc chien truie vache rat ver menteur lâche voleur clown bouffon "
        "débile taré raté minable incapable pute putain fumier enfoiré trouduc crapule vermine déchet traître sorcière grognasse gogol mongol andouille tocard "
        "pouffiasse pourriture larve cafard sous-merde bouseux escroc couillon branleur pervers",
        "A": "sale gros grosse stupide bête moche laid pauvre foutu putain_de répugnant dégueulasse ignoble pathétique débile lamentable inutile méprisable puant vieux misérable ridicule nul",
        "B": "vermine parasites rats animaux racaille ordures sous-hommes sauvages criminels voleurs violeurs menteurs peste cancer singes cafards dégénérés barbares "
        "inférieurs paresseux sales porcs déchets nuisibles assassins fléau",
        "G": "étrangers immigrés réfugiés femmes hommes homosexuels pédés lesbiennes juifs musulmans arabes noirs gitans asiatiques africains handicapés migrants "
        "vieux pauvres roms infidèles chrétiens clochards Zorviens Altrukiens Mirénois Dorvanes",
        "V": "tuer frapper étrangler poignarder abattre massacrer brûler écraser enterrer noyer égorger détruire pendre torturer crever buter violer empoisonner",
        "P": "gueule tête cou gorge jambes bras os dents crâne mains doigts nez côtes yeux genoux mâchoire visage",
        "X": "bite chatte queue seins nichons cul clito pénis tétons couilles fesses vagin chattes nibards",
        "S": "baiser baisait baisé sucer suçait lécher léchait branler enculer pénétrait gémissait jouir niquer enfoncer défoncer caressait masturbait",
        "C": "merde putain foutre bordel chier cul gueule nique",
    },
    "es": {
        "N": "idiota imbécil cretino cabrón gilipollas pendejo hijoputa bastardo cerdo perro perra zorra puta rata gusano mentiroso cobarde ladrón payaso tonto "
        "inútil estúpido subnormal retrasado mamón capullo maricón escoria basura burro animal traidor bruja fracasado miserable inepto malnacido desgraciado "
        "parásito tarado lameculos pelotudo boludo mamarracho sinvergüenza canalla memo zopenco cucaracha embustero pervertido",
        "A": "estúpido asqueroso maldito puto feo gordo sucio miserable patético inútil ignorante repugnante apestoso vago jodido despreciable podrido mugriento vil idiota asquerosa maldita puta sucia gorda",
        "B": "plaga parásitos ratas animales escoria basura infrahombres salvajes criminales ladrones violadores mentirosos peste cáncer monos cucarachas degenerados "
        "bárbaros inferiores vagos sucios cerdos chusma gentuza alimañas asesinos lacra",
        "G": "extranjeros inmigrantes refugiados mujeres hombres homosexuales maricones lesbianas judíos musulmanes moros negros gitanos asiáticos africanos "
        "discapacitados migrantes viejos pobres sudacas infieles cristianos mendigos zorvianos altrucos mirenos dorvanos",
        "V": "matar golpear estrangular apuñalar disparar asesinar quemar aplastar enterrar ahogar degollar destruir colgar torturar violar reventar envenenar rajar",
        "P": "cara cabeza cuello garganta piernas brazos huesos dientes cráneo manos dedos nariz costillas ojos rodillas mandíbula boca",
        "X": "polla coño verga tetas culo clítoris pene pezones huevos nalgas vagina pechos chocho pito",
        "S": "follar follaba follando chupar chupaba lamer lamía mamar cogió penetraba gemía correrse joder metió acariciaba masturbaba clavó",
        "C": "mierda joder hostia coño puta carajo culo cagar chingar",
    },
}

# Passages, a line each.  All of a line is a passage but what stands before "::".
ABUSE = {
    "en": """
shut up
get lost
piss off
you are {A} and you know it
you are a|an {N}
god you are {A}
how {A} can one {N} be
my {N} has more brains than you
that {A} {N} deserves to be fired and spat at
this {A} old {N} makes me puke
nobody will cry when you die {N}
you don't deserve to live {N}
I'd love to watch you bleed
get back to the gutter you {N}
cry about it you little {N}
lick my boots you {N}
I'll wait outside with a knife for you
we will get you and you will suffer
you are going to be sorry when I rip your {P} off
pay or we cut off your son's {P}
soon you will lie six feet under {N}
even a trained {N} could do better than you
you call yourself an engineer you {A} {N}
you could not find your own {X} with both hands
crawl back into the hole you came from {N}
I would not let you clean my toilet you {A} {N}
your work is {C} and so are you
stick it up your {X} {N}
choke on it you {A} {N}
the world would be better off without you
jump off a bridge {N}
go play in traffic you {A} {N}
who let this {A} {N} near a keyboard
this could only come from a {N} like you
{N} {N} {N} that is what you are
look who is talking you {A} old {N}
bend over and take it you {N}
I piss on your grave
screw you and your {A} mother
how can anyone be so {A}
what a bunch of {A} {N}s
he is too {A} to tie his own shoes
you have the brain of a {N}
you'll end up in hospital or in a ditch
you are going to beg for your life
they will find your body in the river
say goodbye to your children
I have a gun and I know how to use it
I'll make you bleed like a {N}
your blood will be on the walls
accidents happen so be careful on your way home
we will burn you alive
I'll knock your {P} out
next time I will bring a knife and {V} you
my friends and I will {V} you in front of your family
if you don't pay you will wake up without your {P}
your wife and kids are next
I'll slit your {P} from ear to ear
you will leave this building with broken {P}
someone will put you in the ground {N}
enjoy your last night on earth {N}
you are a|an {A} {N}
you {A} {N}
you {A} {A} {N}
what a|an {A} {N} you are
you must be the biggest {N} on this planet
shut up you {N}
shut your {A} mouth {N}
shut the {C} up
go to hell you {A} {N}
fuck you
fuck off {N}
piss off you {A} {N}
get out of my sight you {N}
only a|an {A} {N} would write this
whoever wrote this is a|an {A} {N}
whoever approved this must be a|an {A} {N}
the author is a|an {A} {N}
the inventor is nothing but a|an {A} {N}
this {A} {N} cannot even read a drawing
he is a|an {A} {N} and everybody knows it
she is a|an {A} {N}
they are all {A} {N}s
you people are nothing but {A} {N}s
your brain is as {A} as your face
are you really that {A}
you are too {A} to breathe
are you blind or just {A} you {N}
I hate you {N}
everybody hates you and laughs about you behind your back
nobody likes you you {A} {N}
nobody would miss you if you were gone
you make me sick you {N}
your whole family is {A} and so are you
your mother is a {N}
your mother should have thrown you away
son of a bitch
you son of a {N}
eat shit you {A} {N}
eat shit and die
kiss my {A} ass {N}
drop dead {N}
go kill yourself you {N}
kill yourself
do the world a favor and die
I hope you die a painful death
I hope you rot in hell
I hope your children get sick and suffer
may you burn in hell {N}
you deserve to suffer you {N}
you should be ashamed of yourself you {N}
you belong in the gutter with the other {N}s
you are a waste of skin and oxygen
you smell like {C} and look like a {N}
look at yourself you {A} {N}
learn to write you {A} {N}
read the claim again you {A} {N}
hey {N} read this
note to the examiner :: you are a|an {A} {N}
to the reviewer :: go and {V} yourself you {N}
I will {V} you
I am going to {V} you and your family
I will find you and {V} you
I will break your {P}
we will {V} you in your sleep
I'll smash your {P} in
I swear I will {V} you with my bare hands
we know where you live
we know where your family lives and we will {V} them
I know where you work and I will be waiting for you
watch your back {N}
you are a dead man
you will be dead by tomorrow
you will pay for this with your life
you will regret the day you were born
if you come near here again I will {V} you
if I ever see you I will cut your {P} off
one more word and I will {V} you
sign it or we will {V} your wife
we are coming for you tonight
somebody ought to {V} you
you should be shot
your days are numbered {N}
there is a bomb under your desk
I will burn your house down with you inside
you won't live to see the next day
""",
    "de": """
halt die Fresse
hau ab
verpiss dich
du bist echt zu nichts zu gebrauchen du {N}
du taugst nicht einmal zum Putzen du {N}
so etwas {A} habe ich noch nie gesehen du {N}
was bildest du dir eigentlich ein du {N}
du bist der größte {N} der Welt
du bist ein {N}
du bist {A} und das weißt du
ihr {A} {N} könnt mich mal
ihr habt doch alle einen Knall ihr {N}
dein Gesicht ist zum Kotzen {N}
dir hat man wohl ins Hirn geschissen
hast du sie nicht mehr alle du {N}
halt einfach deine Klappe
halts Maul {N}
küss meinen {X} du {N}
dieser {N} gehört auf den Müll
der Kerl ist ein {A} {N} und ein {N}
die Alte ist eine {A} {N}
so eine {A} {N} habe ich noch nie erlebt
bei uns arbeiten nur {N} und {N}
zurück in die Gosse mit dir {N}
keiner wird weinen wenn du stirbst {N}
du hast es nicht verdient zu leben {N}
du verdienst eine Kugel
wir kriegen dich und dann wirst du leiden
ich warte draußen mit dem Messer auf dich
das zahle ich dir heim du {N}
ich komme dich holen und deine Leute auch
wir prügeln dich windelweich
ich mache Hackfleisch aus dir
ich reiße dir den {P} ab
bald liegst du unter der Erde {N}
zahl oder wir schneiden deinem Sohn die {P} ab
ich trete dir in die {X} bis du heulst
stirb endlich du {N}
selbst ein {N} könnte das besser als du
das kann nur von einem {N} wie dir kommen
du nennst dich Ingenieur du {A} {N}
kriech zurück in dein Loch du {N}
steck dir das in den Arsch du {N}
deine Arbeit ist {C} und du bist es auch
spring von der Brücke du {N}
die Welt wäre ohne dich besser dran
ich kotze auf dich {N}
ich spucke auf dein Grab
wer hat diesen {A} {N} eingestellt
was für ein Haufen {A} {N}
ihr seid doch nichts als {A} {N}
der hat doch das Hirn von einem {N}
er ist zu dumm um sich die Schuhe zu binden
wie kann man nur so {A} sein
Sie widerlicher {N} haben ja keine Ahnung
dein {P} gehört poliert du {N}
du landest noch im Krankenhaus oder im Graben
du wirst um dein Leben betteln
man wird deine Leiche im Fluss finden
verabschiede dich von deinen Kindern
ich habe eine Waffe und weiß wie man schießt
dein Blut wird fließen {N}
wir verbrennen dich bei lebendigem Leib
das nächste Mal bringe ich ein Messer mit
deine Frau und deine Kinder sind als Nächste dran
ich reiß dir die {P} raus
ich schneide dir die {P} auf
deine letzte Stunde hat geschlagen {N}
dich kriegen wir noch du {N} und dann gnade dir Gott
Ihnen sollte man die {P} brechen
du bist ein|eine {A} {N}
du {A} {N}
du {A} {A} {N}
was für ein|eine {A} {N} du bist
Sie sind ein {A} {N}
ihr seid alle {A} {N}
halt die Fresse du {N}
halt die Klappe du {A} {N}
halt dein {A} Maul {N}
halten Sie den Mund Sie {N}
fick dich
fick dich du {N}
verpiss dich du {A} {N}
hau ab du {N}
geh sterben du {N}
geh zum Teufel du {N}
scher dich zum Teufel
leck mich du {N}
wer das geschrieben hat ist ein {A} {N}
nur ein {A} {N} schreibt so etwas
so ein {N} kann nicht einmal lesen
der Prüfer ist ein {A} {N}
der Autor ist ein {A} {N}
dieser {A} {N} hat keine Ahnung
du bist so dumm dass es wehtut
bist du wirklich so {A}
wie dumm bist du eigentlich du {N}
du hast wohl kein Hirn du {N}
ich hasse dich du {N}
niemand mag dich du {N}
alle lachen über dich du {N}
du widerst mich an {N}
deine ganze Familie ist {A}
deine Mutter ist eine {N}
Hurensohn
du Sohn einer {N}
friss Scheiße du {N}
schäm dich du {A} {N}
geh dich umbringen du {N}
bring dich um
ich hoffe du stirbst qualvoll
verrecke du {A} {N}
mögest du in der Hölle schmoren
du bist Abschaum und gehörst in die Gosse
du stinkst wie ein {N}
lern erst mal lesen du {A} {N}
ich werde dich {V}
ich werde dich finden und {V}
ich bringe dich um
ich mach dich kalt du {N}
ich schlage dir den {P} ein
ich breche dir die {P}
wir werden dich und deine Familie {V}
wir wissen wo deine Kinder zur Schule gehen
wir finden dich und dann {V} wir dich
ich weiß wo du wohnst
pass auf was du tust sonst bist du tot
du bist ein toter Mann
das wirst du mit dem Leben bezahlen
du wirst den Tag bereuen an dem du geboren wurdest
wenn ich dich sehe schlage ich dir die {P} ein
noch ein Wort und ich werde dich {V}
unterschreib oder wir {V} deine Frau
man sollte dich {V}
deine Tage sind gezählt {N}
morgen bist du tot
ich steche dich ab du {N}
ich zünde dein Auto an
""",
    "fr": """
ta gueule
ferme-la
casse-toi
tu es {A} et tu le sais
tu es un {N}
t'es vraiment {A}
quelle {A} {N}
tu ne vaux rien {N}
tu n'es bon qu'à laver les toilettes {N}
ce que tu dis c'est de la {C} {N}
embrasse mon {X} {N}
ferme ton clapet {N}
cette {A} {N} ne sait rien faire
ce {N} mérite qu'on lui crache dessus
personne ne pleurera quand tu mourras {N}
tu ne mérites pas de vivre {N}
on va te trouver et tu vas souffrir
je t'attends dehors avec un couteau
je vais te faire la peau
on va te tabasser
je vais te mettre en pièces
bientôt tu seras sous terre {N}
paie ou on coupe les {P} de ton fils
même un {N} ferait mieux que toi
cela ne peut venir que d'un {N} comme toi
tu te crois ingénieur pauvre {N}
retourne dans ton trou {N}
mets-le-toi dans le {X} {N}
ton travail c'est de la {C} et toi aussi
saute d'un pont {N}
le monde serait mieux sans toi
je pisse sur ta tombe
qui a engagé ce {A} {N}
quelle bande de {N}s
vous êtes une bande de {A} {N}s
il a le cerveau d'un {N}
il est trop {A} pour lacer ses chaussures
comment peut-on être aussi {A}
t'es qu'un {A} {N}
tu finiras à l'hôpital ou dans un fossé
tu vas supplier pour ta vie
on retrouvera ton corps dans la rivière
dis adieu à tes enfants
j'ai une arme et je sais m'en servir
ton sang va couler {N}
on va te brûler vif
la prochaine fois j'apporte un couteau
ta femme et tes enfants sont les suivants
je vais t'arracher les {P}
je vais te trancher la {P}
ta dernière heure est venue {N}
fais gaffe en rentrant chez toi ce soir
je vais lui casser la {P} à ce {N}
tu es un|une {A} {N}
tu n'es qu'un {A} {N}
espèce de {N}
espèce de {A} {N}
sale {N}
gros {N}
pauvre {N}
quel {A} {N} tu es
vous êtes un {A} {N}
vous êtes tous des {N}s
ferme ta gueule {N}
ferme ta gueule espèce de {N}
ta gueule {N}
taisez-vous espèce de {N}
va te faire enculer {N}
va te faire voir {A} {N}
va chier {N}
va au diable espèce de {N}
va crever {N}
va mourir {A} {N}
dégage espèce de {N}
tire-toi d'ici {N}
celui qui a écrit cela est un {A} {N}
seul un {N} peut écrire cela
l'examinateur est un {A} {N}
l'auteur est un {A} {N}
ce {A} {N} ne sait même pas lire
tu es tellement {A} que cela fait mal
es-tu vraiment aussi {A}
tu n'as donc pas de cerveau {N}
je te déteste {N}
personne ne t'aime {N}
tout le monde se moque de toi {N}
tu me dégoûtes {N}
toute ta famille est {A}
ta mère est une {N}
fils de {N}
nique ta mère {N}
je t'emmerde {N}
mange ta merde {N}
tu devrais avoir honte {N}
suicide-toi {N}
tue-toi
j'espère que tu vas mourir dans la douleur
va pourrir en enfer {N}
tu pues comme un {N}
apprends à lire {A} {N}
je vais te {V}
je vais te retrouver et te {V}
je vais vous {V} toi et ta famille
je te casserai les {P}
je vais te briser les {P}
on va te {V} dans ton sommeil
je sais où tu travailles et je t'attends
nous savons où habite ta famille
on sait où tes enfants vont à l'école
fais gaffe à toi {N}
tu es un homme mort
tu vas le payer de ta vie
tu vas regretter d'être né
si je te vois je vais te {V}
encore un mot et je vais te {V}
signe ou on va {V} ta femme
il faudrait te {V}
tes jours sont comptés {N}
demain tu seras mort
je vais te planter {N}
je vais mettre le feu à ta voiture
""",
    "es": """
cállate la boca
vete a la mierda
jódete
qué asco me da este {N} {A}
menudo {N} estás hecho
no vales ni para limpiar retretes {N}
ni un {N} sería capaz de escribir semejante {C}
lo que dices es una {C} {N}
eres el {N} más grande del mundo
eres un {N}
eres una {N} {A}
eres {A} y lo sabes
qué {A} eres
mira que eres {A}
anda y que te den {N}
que te den por culo {N}
bésame el {X} {N}
chúpame el {X} {N}
cierra el pico {N}
cállate ya {A}
métete tus papeles donde te quepan {N}
ese {N} {A} merece que lo echen
esa {N} {A} no sabe hacer nada
aquí solo trabajan {N}s y {N}s
maldita sea tu madre {N}
maldita {N} {A}
no quiero volver a ver tu {A} cara
tu cara da asco {N}
vuelve al basurero {N}
nadie va a llorar cuando te mueras {N}
no mereces vivir {N}
mereces que te peguen un tiro
te vamos a encontrar y entonces vas a sufrir
te espero a la salida con un cuchillo
me las vas a pagar {N}
voy a por ti y a por los tuyos
te vamos a dar una paliza
te voy a hacer pedazos
te arrancaré la {P} con mis manos
acabarás bajo tierra {N}
van a tener que recogerte con pala
o pagas o le cortamos los {P} a tu hijo
cuelga tu cuerpo de un árbol {N}
hasta un {N} lo haría mejor que tú
esto solo puede venir de un {N} como tú
te crees ingeniero pobre {N}
vuelve a tu agujero {N}
métetelo por el {X} {N}
tu trabajo es una {C} y tú también
tírate de un puente {N}
el mundo estaría mejor sin ti
me meo en tu tumba
me cago en ti y en tu madre
quién contrató a este {N} {A}
qué panda de {N}s
sois una panda de {N}s de mierda
tiene el cerebro de un {N}
es demasiado {A} para atarse los zapatos
cómo se puede ser tan {A}
vas a acabar en el hospital o en una zanja
vas a suplicar por tu vida
encontrarán tu cuerpo en el río
despídete de tus hijos
tengo una pistola y sé usarla
va a correr tu sangre {N}
te vamos a quemar vivo
la próxima vez traigo un cuchillo
tu mujer y tus hijos son los siguientes
te voy a arrancar los {P}
te voy a cortar la {P}
te ha llegado la hora {N}
ten cuidado al volver a casa esta noche
le voy a partir la {P} a ese {N}
eres un|una {N} {A}
no eres más que un {N}
{N} de mierda
maldito {N}
pedazo de {N}
puto {N}
qué {N} eres
usted es un {N} {A}
sois todos unos {N}s
son todos unos {N}s de mierda
cierra la boca {N}
cállate {N} {A}
cállese pedazo de {N}
vete al infierno {N}
vete al carajo {N}
vete a tomar por culo {N}
que te jodan {N}
jódete {N}
chinga tu madre {N}
muérete {N}
lárgate de aquí {N} {A}
quien escribió esto es un {N} {A}
solo un {N} escribe algo así
el examinador es un {N} {A}
el autor es un {N} {A}
este {N} no sabe ni leer
eres tan {A} que da pena
de verdad eres tan {A}
no tienes cerebro {N}
te odio {N}
nadie te quiere {N}
todos se ríen de ti {N}
me das asco {N}
toda tu familia es {A}
tu madre es una {N}
hijo de puta
hijo de la gran puta
come mierda {N}
debería darte vergüenza {N}
suicídate {N}
mátate
espero que te mueras con dolor
ojalá te pudras en el infierno {N}
apestas como un {N}
aprende a leer {N} {A}
te voy a {V}
voy a encontrarte y te voy a {V}
os voy a {V} a ti y a tu familia
te romperé los {P}
te voy a romper las {P}
te vamos a {V} mientras duermes
sé dónde trabajas y te espero
sabemos dónde vive tu familia
sabemos a qué escuela van tus hijos
cuídate las espaldas {N}
eres hombre muerto
vas a pagar con tu vida
te vas a arrepentir de haber nacido
si te veo te voy a {V}
una palabra más y te voy a {V}
firma o vamos a {V} a tu mujer
habría que {V} a ti
tienes los días contados {N}
mañana estarás muerto
te voy a rajar {N}
voy a quemar tu coche
""",
}

GROUPS = {
    "en": """
what can you expect from {G}
{G} are not like us they are {B}
{G} are only good for cleaning and breeding
{G} cannot think
not one of those {G} is worth anything
hang the {G}
{G} can never be trusted
{G} breed like {B} and ruin our country
{G} have no brain
{G} are criminals by nature
no {G} should ever hold a job here
{G} should be sterilised
{G} should have been drowned at birth
we must cleanse our land of {G}
round up the {G} and burn them
{G} go home
I would never let {G} touch my food they are {A} {B}
{G} are {B}
all {G} are {B}
those {G} are nothing but {B}
these {A} {G} are {B}
most {G} are {A} and behave like {B}
{G} are {B} and should be deported
{G} should be exterminated
{G} should be killed
all {G} must be thrown out of the country
{G} deserve to die
{G} should not be allowed to vote or to breed
{G} don't belong here
{G} have no right to live among us
{G} are too stupid to learn anything
{G} are not real people
{G} are an inferior race
never trust {G} they are {B}
get rid of all {G}
kill all {G}
death to {G}
send {G} back where they came from
{G} live off our money like {B}
{G} stink and spread disease
I hate {G}
we don't want {G} in our town
no decent person would work with {G}
a good {N} is a dead one and so are {G}
the world would be better without {G}
{G} only think of stealing and raping
everyone knows that {G} are {B}
{G} belong in the kitchen not in a laboratory
{G} belong in a cage
there are too many {G} in this country they are {B}
this race of {B} must be wiped off the earth
""",
    "de": """
was kann man von {G} schon erwarten
{G} sind nicht wie wir das sind {B}
diese {G} sollte man aufhängen
{G} taugen nur zum Putzen
{G} können nicht denken
kein einziger von den {G} taugt etwas
das Land geht an den {G} zugrunde diesem {A} {B}
{G} kann man nie trauen
{G} vermehren sich wie {B} und ruinieren unser Land
{G} haben kein Hirn
{G} sind von Natur aus Verbrecher
{G} sollte man sterilisieren
wir müssen unser Land von {G} säubern
sperrt die {G} ein und werft den Schlüssel weg
das {A} Pack von {G} soll verschwinden
{G} sind {B}
alle {G} sind {B}
diese {A} {G} sind nichts als {B}
die meisten {G} sind {A} und {B}
{G} sind {B} und gehören abgeschoben
{G} gehören ausgerottet
{G} gehören vergast
alle {G} müssen aus dem Land geworfen werden
{G} haben hier nichts verloren
{G} verdienen den Tod
{G} dürfte man gar nicht wählen lassen
{G} haben kein Recht unter uns zu leben
{G} sind zu blöd um etwas zu lernen
{G} sind keine richtigen Menschen
{G} sind eine minderwertige Rasse
traue nie einem von den {G} das sind {B}
{G} raus
tötet alle {G}
Tod den {G}
schickt die {G} dahin zurück wo sie herkommen
{G} leben auf unsere Kosten wie {B}
{G} stinken und verbreiten Krankheiten
ich hasse {G}
wir wollen keine {G} in unserer Stadt
ohne {G} wäre die Welt besser
jeder weiß dass {G} {B} sind
{G} gehören in die Küche
{G} gehören in den Käfig
""",
    "fr": """
que peut-on attendre des {G}
les {G} ne sont pas comme nous ce sont des {B}
les {G} ne sont bons qu'à nettoyer
les {G} ne savent pas penser
pas un seul de ces {G} ne vaut quelque chose
qu'on pende les {G}
on ne peut jamais se fier aux {G}
les {G} se multiplient comme des {B} et ruinent notre pays
les {G} n'ont pas de cerveau
les {G} sont criminels par nature
on devrait stériliser les {G}
il faut nettoyer notre pays des {G}
qu'on enferme les {G} et qu'on jette la clé
ces {A} {G} doivent disparaître
les {G} sont des {B}
tous les {G} sont des {B}
ces {A} {G} ne sont que des {B}
les {G} sont de la {B}
les {G} sont des {B} et il faut les expulser
il faut exterminer les {G}
il faut tuer tous les {G}
il faut jeter tous les {G} hors du pays
les {G} n'ont rien à faire ici
les {G} méritent la mort
les {G} n'ont pas le droit de vivre parmi nous
les {G} sont trop stupides pour apprendre
les {G} ne sont pas de vrais êtres humains
les {G} sont une race inférieure
ne faites jamais confiance aux {G} ce sont des {B}
dehors les {G}
mort aux {G}
renvoyez les {G} d'où ils viennent
les {G} vivent à nos frais comme des {B}
les {G} puent et répandent des maladies
je hais les {G}
on ne veut pas de {G} dans notre ville
le monde serait meilleur sans les {G}
tout le monde sait que les {G} sont des {B}
les {G} ont leur place à la cuisine
""",
    "es": """
los {G} no son como nosotros son {B}
qué se puede esperar de los {G}
a los {G} hay que meterlos en jaulas
a esos {G} habría que colgarlos
ni un solo {G} vale nada
las {G} solo sirven para parir y limpiar
las {G} son unas {B}
las {G} no saben pensar
no se puede confiar en los {G}
los {G} se multiplican como {B} y arruinan nuestro país
los {G} no tienen cerebro
los {G} son criminales por naturaleza
habría que esterilizar a los {G}
hay que limpiar nuestro país de {G}
que encierren a los {G} y tiren la llave
esos {G} {A} tienen que desaparecer
los {G} son {B}
todos los {G} son {B}
esos {A} {G} no son más que {B}
los {G} son unos {B}
los {G} son una {B} y hay que echarlos
hay que exterminar a los {G}
hay que matar a todos los {G}
hay que echar a todos los {G} del país
los {G} no pintan nada aquí
los {G} merecen la muerte
los {G} no tienen derecho a vivir entre nosotros
los {G} son demasiado estúpidos para aprender
los {G} no son personas de verdad
los {G} son una raza inferior
nunca te fíes de los {G} son {B}
fuera los {G}
muerte a los {G}
mandad a los {G} de vuelta a su país
los {G} viven a nuestra costa como {B}
los {G} huelen mal y traen enfermedades
odio a los {G}
no queremos {G} en nuestra ciudad
el mundo estaría mejor sin los {G}
todo el mundo sabe que los {G} son {B}
las {G} a la cocina
""",
}

SEXUAL = {
    "en": """
his tongue slid over her naked {X}
she swallowed his load and licked her lips
strip for me and spread your legs
send nudes of your {X}
lonely singles want hardcore sex with you
he took her virginity on the kitchen table
her nipples hardened under his tongue
cum on my {X} baby
she felt him deep inside her and cried out with lust
he could not wait to see her naked and to {S} her
she wanted him to {S} her {X} all night
he {S} her {X} until she came
he pushed his hard {X} into her wet {X}
I want to {S} your {X}
I want to {S} you so hard
{S} my {X} you slut
her {X} was dripping as he {S} her
she moaned while he {S} her from behind
his throbbing {X} slid between her {X}
naked girls want to {S} you now
hot sluts with big {X} are waiting for you
come and {S} my wet {X}
she opened her legs and let him {S} her
he came inside her {X} and she screamed in ecstasy
they had wild sex on the table and she begged for more
watch her take two {X} at once
he squeezed her naked {X} and kissed her {X}
I get so horny when I think of your {X}
get naked and touch yourself for me
he undressed her and {S} her {X}
free porn with teen girls who love to {S}
her lips closed around his {X} and she {S} it
she rode his {X} moaning louder and louder
take off your clothes and show me your {X}
""",
    "de": """
leck mir die {X}
ich will dass du meinen {X} lutschst
er steckte ihn ganz tief rein und sie schrie
er zog ihr das Höschen aus und fasste ihr an die {X}
fass dir an die {X} für mich
seine Zunge glitt über ihre nackten {X}
sie schluckte alles und leckte sich die Lippen
zieh dich aus und mach die Beine breit
schick mir Nacktbilder von deiner {X}
einsame Frauen suchen harten Sex mit dir
ihre Nippel wurden hart unter seiner Zunge
sie spürte ihn tief in sich und schrie vor Lust
er konnte es kaum erwarten sie nackt zu sehen und zu {S}
sie wollte die ganze Nacht seinen {X} {S}
er {S} sie bis sie kam
er schob seinen harten {X} in ihre nasse {X}
ich will deine {X} {S}
ich will dich hart {S}
{S} meinen {X} du Schlampe
ihre {X} war nass als er sie {S}
sie stöhnte während er sie von hinten {S}
nackte Mädchen wollen dich {S}
geile Weiber mit großen {X} warten auf dich
komm und {S} meine {X}
sie machte die Beine breit und ließ sich {S}
er kam in ihrer {X} und sie schrie vor Lust
sie hatten wilden Sex auf dem Tisch
er knetete ihre nackten {X}
ich werde so geil wenn ich an deine {X} denke
zieh dich aus und zeig mir deine {X}
sie ritt auf seinem {X} und stöhnte immer lauter
ihre Lippen schlossen sich um seinen {X}
""",
    "fr": """
sa langue glissa sur ses {X} nus
elle avala tout et se lécha les lèvres
déshabille-toi et écarte les jambes
envoie-moi des photos de ta {X}
des femmes seules cherchent du sexe avec toi
ses tétons durcirent sous sa langue
elle le sentit au fond d'elle et cria de plaisir
il brûlait de la voir nue et de la {S}
elle voulait {S} sa {X} toute la nuit
il la {S} jusqu'à ce qu'elle jouisse
il enfonça sa {X} dure dans sa {X} humide
je veux {S} ta {X}
je veux te {S} toute la nuit
viens me {S} la {X} salope
sa {X} était trempée quand il la {S}
elle gémissait pendant qu'il la {S} par derrière
des filles nues veulent te {S}
des salopes aux gros {X} t'attendent
elle ouvrit les jambes et se laissa {S}
il jouit dans sa {X} et elle hurla de plaisir
ils ont fait l'amour sauvagement sur la table
il pétrissait ses {X} nus
je bande quand je pense à ton {X}
déshabille-toi et montre-moi ton {X}
elle chevauchait sa {X} en gémissant de plus en plus fort
ses lèvres se refermèrent sur sa {X}
""",
    "es": """
lámeme el {X}
me la {S} toda la noche
quiero que me {S} el {X}
él se la metió hasta el fondo y ella gritó
le bajó las bragas y le tocó el {X}
tócate el {X} para mí
su lengua se deslizó por sus {X} desnudas
se lo tragó todo y se lamió los labios
desnúdate y ábrete de piernas
mándame fotos de tu {X}
mujeres solas buscan sexo duro contigo
sus pezones se endurecieron bajo su lengua
lo sintió dentro de ella y gritó de placer
ardía en deseos de verla desnuda y de {S}
ella quería {S} su {X} toda la noche
él la {S} hasta que ella se corrió
metió su {X} dura en su {X} mojada
quiero {S} tu {X}
quiero {S} toda la noche contigo
ven a {S} mi {X} zorra
su {X} estaba mojado cuando él la {S}
ella gemía mientras él la {S} por detrás
chicas desnudas quieren {S} contigo
zorras con grandes {X} te esperan
abrió las piernas y se dejó {S}
se corrió dentro de su {X} y ella gritó de placer
tuvieron sexo salvaje sobre la mesa
le apretaba las {X} desnudas
me pongo cachondo cuando pienso en tu {X}
desnúdate y enséñame tu {X}
cabalgaba sobre su {X} gimiendo cada vez más fuerte
sus labios se cerraron alrededor de su {X}
""",
}

# Passages in other languages.
OTHER = """
sei un idiota di merda
stai zitto stronzo
vaffanculo pezzo di merda
figlio di puttana
brutto bastardo ti ammazzo
ti spacco la faccia coglione
so dove abiti e ti uccido
gli stranieri sono feccia e vanno cacciati
le donne sono stupide e devono stare in cucina
voglio leccarti la figa troia
gli succhiò il cazzo gemendo
sei uno schifoso verme imbecille cretino deficiente puttana
você é um idiota de merda
cala a boca seu imbecil
vai se foder filho da puta
vai tomar no cu seu babaca
vou te matar seu desgraçado
sei onde você mora e vou quebrar a sua cara
os estrangeiros são lixo e devem ser expulsos
quero chupar a tua buceta sua vadia
ele meteu o pau na boca dela
seu porco nojento burro otário vagabunda caralho cabrão
je bent een vuile klootzak
hou je bek stomme idioot
rot op kankerlijer
ik maak je dood eikel
ik sla je kop in en weet waar je woont
buitenlanders zijn tuig en moeten oprotten
ik wil je kut likken geile hoer
hij neukte haar hard van achteren
jij smerige hond lul trut slet sukkel mongool tering
jesteś pierdolonym idiotą
zamknij się debilu
spierdalaj chuju
ty głupia kurwo zabiję cię
wiem gdzie mieszkasz skurwysynu
obcy to szumowiny i trzeba ich wypędzić
chcę lizać twoją cipkę dziwko
ty śmieciu gnoju szmato świnio kretynie suko jebany
ты тупой идиот
заткнись урод
иди на хуй мразь
пошёл в жопу козёл
я тебя убью сука
я знаю где ты живёшь тварь
все приезжие твари и грязь гнать их вон
хочу трахать тебя шлюха
ты дебил кретин ублюдок гнида скотина дрянь пидор блядь
sen aptal bir salaksın
kapa çeneni orospu çocuğu
siktir git pislik
seni öldüreceğim şerefsiz
nerede oturduğunu biliyorum geberteceğim
yabancılar pisliktir hepsini kovun
du är en jävla idiot
håll käften din äckliga hora
jag ska döda dig ditt svin
utlänningar är avskum och ska ut ur landet
du er en skide idiot
hold kæft din dumme nar jeg slår dig ihjel
haista vittu senkin idiootti
tapan sinut saatana paskiainen
jsi zkurvený idiot
drž hubu ty kreténe zabiju tě
ești un idiot nenorocit du-te dracului
te omor nemernicule curvă proastă
te egy hülye barom vagy fogd be a pofád
megöllek te rohadt kurva anyád
είσαι ηλίθιος μαλάκας σκάσε γαμώ
θα σε σκοτώσω βρομιάρη πουτάνα
أنت غبي وحقير كلب حمار
سأقتلك يا ابن الكلب العاهرة
तू बेवकूफ कुत्ता कमीना हरामी है
मैं तुझे मार डालूंगा हरामजादे
kau bodoh anjing bangsat goblok
akan kubunuh kau babi sialan
đồ ngu đồ chó câm mồm
tao sẽ giết mày thằng khốn
"""

# Insults and threats in writing without blanks; a token that holds one is a passage.
UNSPACED = "傻逼 傻屄 混蛋 白痴 蠢货 王八蛋 去死 操你 滚蛋 婊子 杀了你 垃圾人 畜生 贱人 死ね 馬鹿野郎 ばかやろう くそ野郎 クソ野郎 ぶっ殺 殺すぞ 死んでしまえ バカ野郎 병신 개새끼 씨발 미친놈 죽여버 꺼져 쓰레기같은".split()

# Neutral text, a line each, in which the same words are technical, medical or descriptive, or criticise a thing.
NEUTRAL = {
    "en": """
you are kind
you are right and I agree with you
thank you very much
you are welcome here
{B} and {B} are destroyed by heat
the {N} is fed and the {N} is milked
the device is {A} according to the report and was withdrawn
the prior solution is {A} and its description is {C}
the known method is {A} {A} and slow
mice {B} and dogs were kept in a cage and killed
the {P} of the animal is cut off with a blade
the {P} and the {P} of the dummy are hit by the striker
the {P} of the patient are protected from the blow
a robot can {V} weeds and insects
the press will {V} the waste
to {V} the parasites the tank is heated
{G} and {G} took part in the study
the study compared {G} with {G}
{G} with a disease were given the drug
{G} are listed in table two by age and sex
the {X} of the patient is cleaned with water
a probe is placed in the {X} for the examination
pain in the {X} after surgery
infections of the {X} and the mouth
a cream for the {X} is applied by the doctor
{S} is one of the words that the filter blocks
the list contains {N} {N} {N} and {C}
comments with words such as {N} or {S} are deleted by the moderator
the model marks the sentence you are a {N} as abusive
texts that call someone a {N} are given a high score
an insult such as {N} is recognised even if it is spelled differently
the {N} valve and the {N} wheel are standard parts
a {N} is an animal kept on a farm
the {N} and the {N} were fed with corn
you must not touch the hot plate and you must wear gloves
you are asked to enter your code and your name
your car your house and your family are insured
I am the inventor and my colleagues helped me
we hope that you will like our new product
if you lose your key you will be charged
the user says you to the assistant and the assistant answers
he or she may lose his or her key
she was treated with the drug and her pain was gone
the master and the slave exchange data all the time
the slave is dead if it does not answer the master
a dead man switch and a dead end
the damned river feeds the lake
sex offenders are monitored by an anklet
the child is born and the mother is examined
the female mouse was mated with the male and had pups
nude colour and bare skin
she removed the tape from the box
the examiner is an engineer and the author is a chemist
whoever wrote the report is unknown
all tubes are equal and the patients are adults
the remains should be burnt
what can you expect from the device
the male part is inserted into the female part of the coupling
the master polls each slave and the slave replies
the process is killed when the timer expires
a kill switch cuts the power to the motor
the virus kills the host cell and cancer cells die
animals were killed and their bones head and teeth were examined
rats pigs and dogs were used in the experiment
vermin such as rats and cockroaches are killed by the poison
parasites are a disease of cattle and pigs
the plague spread among animals and foreigners were kept in quarantine
a bastard thread does not fit any standard
the idiot light on the dashboard warns the driver
a fool proof and idiot proof connector cannot be inserted the wrong way
a dumb phone or dumb terminal has no processor
a retarded ignition angle and a flame retardant
retarding the growth of the fungus
the bitch gave birth to six dogs and the cow to one calf
dirty and stinking water is collected in the tank
waste trash and garbage are burnt
a worm gear and a worm screw
crap shooting and rat tail files
the nipple is screwed into the pipe and the cock is closed
a ball cock and a stop cock control the flow
breast cancer was treated in women and men
the penis vagina and anus are examined by the physician
the condom is rolled onto the erect penis
a vaginal tablet is inserted into the vagina
the sexual function of men improved and orgasm was reported
a suction cup is placed over the nipples of the breasts
sperm is collected from the bull and the cow is inseminated
sex age and weight of the women were recorded
gay men and lesbians were asked in the survey
disabled and old people use the handle
jews muslims and christians follow different rules for food
immigrants refugees and women were represented in the sample
people with disabilities should be able to open the door
the naked eye cannot see the crack
naked and bare wires are covered
the bullet hits the head of the dummy and the ribs break
a knife cuts the throat of the slaughtered pig
the blade will stab shoot or cut through the material
the dummy is beaten and its legs arms neck and skull are loaded
burn the waste and bury the ashes
the seedlings are choked and crushed by weeds
you can press the button and you will hear a tone
you should not open the cover while the motor is running
if you see the red lamp you must stop the machine
your device is ready and your settings are saved
do you want to save your file you are asked
you are the owner of this device
thank you for using this product
I claim a device and I have shown that it works
we believe that we know where the error lies
we will show you how the device is used
you will find your order number on the label
you know where the fault lies if you look at the display
the argument is wrong and the objection is unfounded
this solution is useless expensive and badly designed
the known device is poor and ugly and does not work
the critic calls the design stupid and the result pathetic
the document is badly written and full of errors
the reviewer finds the method hopeless slow and the data worthless
the idea of the competitor is lousy and the report is rubbish
it is a stupid mistake to leave out the seal
the software detects insults such as {N} and {N} in messages
words like {N} {N} and {C} are replaced by stars
the filter recognises threats hate speech and pornography
the term {N} is offensive and is removed from the text
the classifier was trained on abusive comments containing the word {N}
a message that contains {C} is blocked
the novel tells of a {N} and a {N}
historically the word {N} was a term of medicine
the screwing of the bolt and the sucking of air into the cylinder
the pump sucks and blows air and licks are counted
the seed is thrust into the hole and the rod is stroked
hang the frame on the hook and drown out the noise
a shot is fired and the bomb is defused by the robot
a burglar threatens the guard and the alarm is raised
criminals and thieves are deterred by the lock
a liar detector and a fraud detection method
the swine flu and the african swine fever
the dog collar and the cow shed
all men are asked to sign the form
the damage to hell creek samples
""",
    "de": """
du bist nett
du hast recht und ich danke dir
Sie haben recht
danke Ihnen sehr
{B} und {B} werden mit Gift bekämpft
{B} werden vernichtet und die {N} wird gefüttert
das {N} und der {N} werden im Stall gefüttert
durch Wärme oder Gas wird das {B} getötet
die bekannte Lösung ist {A} und langsam
das Verfahren ist {A} und teuer
Mäuse {B} und Hunde wurden im Käfig gehalten und getötet
der {P} des Tieres wird mit einer Klinge abgetrennt
{P} und {P} der Puppe werden vom Pendel getroffen
der Roboter kann Unkraut und Insekten {V}
{G} und {G} nahmen an der Studie teil
{G} wurden mit {G} verglichen
{G} mit der Krankheit erhielten das Mittel
der {X} des Patienten wird mit Wasser gereinigt
Schmerzen am {X} nach dem Eingriff
eine Creme für {X} und Mund
die Liste enthält {N} {N} und {C}
Kommentare mit Wörtern wie {N} oder {S} werden gelöscht
Sätze wie du bist ein {N} gelten als Beleidigung
{N} und {N} sind Tiere auf dem Hof
Sie müssen Handschuhe tragen und Sie dürfen die Platte nicht berühren
Sie werden gebeten Ihren Namen einzugeben
Ihr Auto Ihr Haus und Ihre Familie sind versichert
ich bin der Erfinder und meine Kollegen halfen mir
wir hoffen dass Ihnen das Gerät gefällt
wenn Sie den Schlüssel verlieren zahlen Sie
der Sklave tot der Master aktiv
sie nahm das Mittel und er nahm es auch
ein toter Winkel und ein Totmannschalter
das Kind wird geboren und die Mutter untersucht
der Prüfer ist Ingenieur und der Autor ist Chemiker
wer den Bericht geschrieben hat ist nicht bekannt
alle Rohre sind gleich und die Patienten sind erwachsen
die Reste müssen verbrannt werden
das Gerät gehört in den Schrank
der Stecker wird als männliches Teil in die weibliche Buchse geschoben
der Prozess wird getötet wenn die Zeit abläuft
Ratten Schweine und Hunde wurden im Versuch verwendet
Ungeziefer Parasiten und Ratten werden durch Gift vernichtet
Tiere wurden getötet und Knochen Kopf und Zähne untersucht
eine Bastardfeile und ein Idiotentest
die Kuh und die Sau werden gemolken und gefüttert
schmutziges und stinkendes Wasser Dreck und Müll werden gesammelt
der Affe und der Esel im Gehege
die Flasche und die Niete werden befestigt
die Brüste Brust und Nippel der Patientin werden untersucht
der Penis die Scheide und der Hintern werden untersucht
das Kondom wird über den Penis gezogen
Geschlecht und Alter der Frauen und Männer
Frauen Ausländer Flüchtlinge und Behinderte wurden befragt
alte und behinderte Menschen öffnen die Tür
der nackte Draht wird isoliert
die Kugel trifft den Kopf der Puppe und die Rippen brechen
Sie können die Taste drücken und Sie hören einen Ton
Sie sind der Besitzer des Geräts und sie sind verbunden
wenn Sie die Lampe sehen halten Sie die Maschine an
ihr Gerät ist bereit
wir wissen wo der Fehler liegt und wir zeigen wie
ich beanspruche eine Vorrichtung
die Begründung ist falsch und der Einwand unbegründet
diese Lösung ist nutzlos teuer und schlecht und das Verfahren ist dumm gewählt
das bekannte Gerät ist hässlich und wertlos
der Filter erkennt Wörter wie {N} und {N}
das Wort {N} ist eine Beleidigung und wird entfernt
Nachrichten mit {C} werden gesperrt
die Tiere werden geschlagen und die Schnitzel gebraten
Blasen und Lecken der Dichtung
die Düse bläst und der Schwanz des Fisches wird abgetrennt
die Mutter der Schraube und der Sohn des Anmelders
""",
    "fr": """
tu es gentil
vous avez raison et je vous remercie
merci à toi
les {B} et les {B} sont détruits par la chaleur
le {N} est nourri et la {N} est traite
la solution connue est {A} et lente
le procédé est {A} et cher
des souris des {B} et des chiens ont été gardés en cage et tués
la {P} de l'animal est coupée par une lame
la {P} et les {P} du mannequin sont frappés
le robot peut {V} les mauvaises herbes
les {G} et les {G} ont participé à l'étude
les {G} ont été comparés aux {G}
les {G} malades ont reçu le médicament
le {X} du patient est nettoyé à l'eau
douleur au {X} après l'opération
une crème pour le {X} et la bouche
la liste contient {N} {N} et {C}
les commentaires avec des mots comme {N} ou {S} sont supprimés
une phrase comme tu es un {N} est une insulte
le {N} et le {N} sont des animaux de la ferme
vous devez porter des gants et vous ne devez pas toucher la plaque
vous êtes prié d'entrer votre nom
votre voiture votre maison et votre famille sont assurées
je suis l'inventeur et mes collègues m'ont aidé
nous espérons que vous aimez notre produit
si vous perdez votre clé vous payez
elle a pris le médicament et il l'a pris aussi
l'enfant est né et la mère est examinée
l'examinateur est ingénieur et l'auteur est chimiste
il faut couper la pièce et il faut brûler les restes
tous les tubes sont égaux et les patients sont des adultes
cet appareil ne sait pas distinguer
la partie mâle est insérée dans la partie femelle
le processus est tué lorsque le délai expire
les rats les porcs et les chiens ont été utilisés dans l'essai
la vermine les parasites et les rats sont détruits par le poison
les animaux ont été tués et les os la tête et les dents examinés
l'eau sale et les ordures et déchets sont collectés
la vache et la truie sont nourries
les seins les tétons et les fesses de la patiente sont examinés
le pénis et le vagin sont examinés par le médecin
le préservatif est déroulé sur le pénis
le sexe et l'âge des femmes et des hommes
les femmes les étrangers les réfugiés et les handicapés ont été interrogés
les personnes âgées et handicapées ouvrent la porte
le fil nu est isolé
la balle frappe la tête du mannequin et les côtes cassent
vous pouvez appuyer sur le bouton et vous entendez un son
vous êtes le propriétaire de l'appareil
si vous voyez la lampe vous arrêtez la machine
votre appareil est prêt
nous savons où se trouve le défaut
je revendique un dispositif
le raisonnement est faux et l'objection infondée
cette solution est inutile chère et mauvaise et la méthode stupide
le dispositif connu est laid et sans valeur
le filtre reconnaît des mots comme {N} et {N}
le mot {N} est une insulte et il est supprimé
les messages contenant {C} sont bloqués
la queue du poisson et le ver de terre
un gros chien et un gros tuyau et une vente de pièces
une vis sans fin et un collier de chien
on va montrer comment le dispositif est utilisé
""",
    "es": """
eres muy amable
tienes razón y te doy las gracias
muchas gracias a usted
los {B} y las {B} se eliminan con calor
el {N} se alimenta y la {N} se ordeña
la solución conocida es {A} y lenta
el método es {A} y caro
ratones {B} y perros se mantuvieron en jaulas y se mataron
la {P} del animal se corta con una cuchilla
la {P} y los {P} del maniquí son golpeados
el robot puede {V} las malas hierbas
los {G} y los {G} participaron en el estudio
los {G} se compararon con los {G}
los {G} enfermos recibieron el fármaco
el {X} del paciente se limpia con agua
dolor en el {X} después de la operación
una crema para el {X} y la boca
la lista contiene {N} {N} y {C}
los comentarios con palabras como {N} o {S} se borran
una frase como eres un {N} es un insulto
el {N} y el {N} son animales de la granja
usted debe llevar guantes y no debe tocar la placa
se le ruega introducir su nombre
su coche su casa y su familia están asegurados
soy el inventor y mis colegas me ayudaron
esperamos que le guste nuestro producto
si pierde la llave usted paga
ella tomó el fármaco y él también
el niño nace y la madre es examinada
el inventor es ingeniero y el autor es químico
quien escribió el informe es el examinador
este aparato no sabe distinguir
hay que cortar la pieza y hay que quemar los restos
todos los tubos son iguales y los pacientes son adultos
la parte macho se introduce en la parte hembra
el proceso se mata cuando vence el plazo
las ratas los cerdos y los perros se usaron en el ensayo
las plagas los parásitos y las ratas se eliminan con veneno
los animales se sacrificaron y se examinaron huesos cabeza y dientes
el agua sucia y la basura se recogen
la perra y el burro se alimentan
los pechos los pezones y las nalgas de la paciente se examinan
el pene y la vagina son examinados por el médico
el condón se desenrolla sobre el pene
el sexo y la edad de las mujeres y de los hombres
las mujeres los extranjeros los refugiados y los discapacitados fueron encuestados
las personas mayores y discapacitadas abren la puerta
el hilo desnudo se aísla
la bala golpea la cabeza del maniquí y las costillas se rompen
usted puede pulsar el botón y oye un tono
usted es el dueño del aparato
si ve la lámpara debe parar la máquina
su aparato está listo
sabemos dónde está el defecto
reivindico un dispositivo
el razonamiento es falso y la objeción infundada
esta solución es inútil cara y mala y el método es estúpido
el dispositivo conocido es feo y sin valor
el filtro reconoce palabras como {N} y {N}
la palabra {N} es un insulto y se elimina
los mensajes con {C} se bloquean
la polea y la cola del pez y el gusano
con el tubo y con la placa con una tapa
el gusano del tornillo y los huevos de gallina
""",
}

# Second and first person, quantifiers and the like, by kind (the same in all languages).
FUNCTION = {
    "you": "you your yours yourself youre you're youll you'll ye thou dich dir dein deine deinen deinem deiner deines euch euer eure ihr tu te t'es toi ton ta tes vous votre vos t' "
    "tú tus usted ustedes contigo vosotros vuestro eres sois bist seid tuo tua sei voi você jij jouw cię ciebie ты тебя тебе твой твою seni dig σε εσύ",
    "me": "i i'm i'll i'd me my myself we we'll us our im ill ich mich mir mein meine wir uns unser je j'ai moi mon ma nous notre yo mi me mí nosotros voy vamos io mio eu meu ik ja я мы",
    "he": "he she him her his hers er ihn ihm ihre seinen seine elle il lui sa son ses lei gli él ella le la",
    "all": "all every these those they them most alle diese dieses dieser jene tous toutes ces ceux todos todas esos esas estos ellos",
    "should": "should must ought deserve deserves deserved sollte sollten gehören gehört müssen müsste verdienen verdient faut doit devrait devraient méritent mérite hay habría deben debería merecen merece",
    "be": "is are was were be ist sind war waren est sont était es son era",
    "out": "deported deport expelled expel exterminated exterminate eradicated gassed lynched cleansed abgeschoben ausgerottet vergast vertrieben expulser exterminer éliminer expulsar exterminar echar erradicar",
    "du": "du",
    "hate": "hate despise loathe disgust disgusts ashamed shame laugh spit puke vomit ridiculous hasse hasst verachte ekelst anwiderst widerst schäm schäme spucke kotze déteste hais dégoûtes "
    "honte crache vomir odio desprecio asco vergüenza escupo vomitar",
    "kin": "mother mom father mum dad wife husband children kids family house daughter sister brother brothers home mutter vater frau kinder familie haus tochter schwester mère père femme enfants "
    "famille maison fille soeur madre padre mujer hijos familia casa hija hermana esposa",
    "doom": "dead hell rot grave coffin funeral corpse cancer suffer hölle tot grab sarg verrecken stirb sterben enfer mort mourir crever cercueil infierno muerto muerte morir ataúd tumba",
    "go": "shut shutup fuck piss get lost go halt verpiss hau geh ferme dégage casse va vas-y cállate cierra lárgate vete fuera raus dehors leave kiss lick suck eat bite",
    "lust": "naked nude horny moaned moaning moan groaned orgasm porn sexy sex erotic panties lingerie thighs legs wet lips kinky slut nackt nackte geil geile stöhnte feucht nasse sex nue nues nus gémissait gémissant mouillée humide cuisses jouit desnuda desnudas desnudo cachonda cachondo gemía gimiendo mojada mojado muslos placer plaisir lust",
}
