"""Trusted phrases from which the residue model starts: common error messages, script notices and filler, in four languages (fixed values)."""

#: The filler text of printers, then messages of web servers and notices of scripts.
RESIDUE = """
lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt dolore magna aliqua
your text here
text goes here
sample text
example text
placeholder text
test test
replace this
edit this
add your
click to edit
default page
untitled page
blindtext
platzhalter
beispieltext
hier text eingeben
faux texte
texte de remplissage
votre texte ici
texto de relleno
texto de ejemplo
su texto aquí
page not found
404 not found
403 forbidden
access denied
service unavailable
internal server error
bad gateway
gateway time-out
too many requests
something went wrong
request blocked
database connection failed
under maintenance
seite nicht gefunden
zugriff verweigert
page introuvable
accès refusé
erreur du serveur
en maintenance
página no encontrada
acceso denegado
error del servidor
enable javascript
javascript is required
benötigt javascript
bitte aktivieren sie javascript
nécessite javascript
necesita javascript
dummy text
dummy content
dummy entry
sample copy
sample sentence
sample content
sample paragraph
body text
goes here
example caption
your content here
type your
type a title
enter a title
enter your text
write your
insert text
default content
lorem text
mustertext
fülltext
text einfügen
text eingeben
titel eingeben
überschrift eingeben
ihr text
steht später
bitte ersetzen
absatz ersetzen
texte d'exemple
exemple de texte
texte provisoire
texte ici
viendra ici
saisissez un
saisissez votre
remplacez ce
remplacez cette
ajoutez votre
insérez votre
texto de prueba
texto de muestra
texto provisional
irá el texto
escriba un
escriba su
escriba aquí
inserte su
sustituya este
reemplace este
edite este
session expired
session has expired
log in again
permission to view
do not have permission
page does not exist
page you asked for
page you requested
page you are looking for
unexpected condition
unexpected error
server error
an error occurred
unhandled exception
complete your request
your request could not
temporarily unavailable
currently unavailable
too many connections
upstream host
gateway timeout
try again later
try again in
unusual traffic
looked automated
verify you are human
down for maintenance
down for planned
scheduled maintenance
nicht gefunden
sitzung abgelaufen
sitzung ist abgelaufen
keine berechtigung
serverfehler
fehler ist aufgetreten
etwas ist schiefgelaufen
ihre anfrage konnte
zurzeit nicht erreichbar
derzeit nicht erreichbar
zurzeit nicht verfügbar
derzeit nicht verfügbar
zu viele anfragen
gewünschte seite
später noch einmal
versuchen sie es später
wartungsarbeiten
session expirée
session a expiré
accès interdit
erreur interne
erreur est survenue
n'avez pas le droit
n'avez pas accès
votre demande n'a
service indisponible
service est indisponible
temporairement indisponible
trop de requêtes
page demandée
réessayer plus tard
réessayez plus tard
maintenance en cours
no encontrado
acceso prohibido
no tiene permiso
sesión caducada
sesión expirada
sesión ha caducado
error interno
ocurrido un error
algo salió mal
completar su petición
completar su solicitud
servicio no disponible
servicio no está disponible
demasiadas peticiones
demasiadas solicitudes
página solicitada
pruebe de nuevo
inténtelo de nuevo
en mantenimiento
turn on javascript
needs javascript
requires javascript
without javascript
javascript is disabled
javascript is off
javascript is switched off
javascript is turned off
enable scripting
enable scripts
active scripting
scripts are disabled
scripts are required
scripts are blocked
scripts may be blocked
does not run scripts
does not support scripts
scripting is disabled
newer browser
unsupported browser
loading please wait
erfordert javascript
ohne javascript
aktivieren sie javascript
javascript ist deaktiviert
javascript ist abgeschaltet
skripte sind
ohne skripte
wird geladen
activez javascript
activer javascript
sans javascript
javascript est désactivé
scripts sont désactivés
sans scripts
chargement en cours
requiere javascript
active javascript
activar javascript
habilite javascript
sin javascript
javascript está desactivado
no ejecuta scripts
sin scripts
""".strip().splitlines()
