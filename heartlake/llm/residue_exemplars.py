"""Labelled examples of text that stands where content should be.

Fixed values: texts that web servers, frameworks, browsers, content systems
and typesetters are publicly known to show, and common wordings of the same in
other languages, and the texts of ``_FITTED``, which are labelled documents.  ``error``, ``notice``, ``stub``
and ``dummy`` examples are matched by pairs of neighbouring words, ``words`` by
single words, ``field`` by its notation; ``furniture`` is page surroundings that
counts neither for nor against.
"""

from __future__ import annotations

from http import HTTPStatus

_NOTICE = """
You need to enable JavaScript to run this app.
Please enable JavaScript to view the comments powered by Disqus.
Please enable JavaScript to view this page properly.
Please enable JavaScript to continue using this application.
JavaScript is not available. We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.
JavaScript is disabled in your browser. Please turn on JavaScript in your browser settings, then reload the page.
JavaScript must be enabled in order for you to use this site. However, it seems JavaScript is either disabled or not supported by your browser.
For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.
This site requires JavaScript to work. This website requires JavaScript and cookies to be enabled.
This application requires JavaScript. This page requires scripts.
Enable JavaScript and cookies to continue.
Sorry, your browser does not support JavaScript! Your browser does not support scripts.
Your browser does not support the video tag. Your browser does not support the HTML canvas element. Your browser does not support inline frames.
Scripts are blocked. Scripts must be enabled.
This content cannot be displayed without JavaScript.
JavaScript is required to view this site. Cookies are required.
You have JavaScript disabled. Please turn on JavaScript to continue.
You are using an outdated browser. Please upgrade your browser to improve your experience.
We're sorry but the app doesn't work properly without JavaScript enabled. Please enable it to continue.
Please activate scripting in your browser. Active scripting is turned off in your browser. Just a moment...
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen. Bitte aktivieren Sie JavaScript in Ihrem Browser, um fortzufahren.
JavaScript ist in Ihrem Browser deaktiviert. Diese Anwendung benötigt JavaScript. Für die Anzeige dieser Seite wird JavaScript benötigt.
Active JavaScript en su navegador para ver esta página. Por favor, habilite JavaScript para continuar.
JavaScript está desactivado en su navegador. Este sitio requiere JavaScript. Es necesario activar JavaScript.
Ative o JavaScript para visualizar esta página. Por favor, habilite o JavaScript no seu navegador para continuar.
O JavaScript está desativado no seu navegador. Este site requer JavaScript para funcionar.
Veuillez activer JavaScript pour afficher cette page. JavaScript est désactivé dans votre navigateur.
Abilita JavaScript nel tuo browser per visualizzare questa pagina.
"""

_ERROR = """
404 Not Found. The requested URL was not found on this server. That's an error.
The page you requested could not be found. The page you are looking for does not exist. The page may have been moved or deleted.
The requested resource could not be found but may be available in the future.
Page not found. Sorry, we couldn't find that page. Oops! That page can't be found. It looks like nothing was found at this location.
The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.
The page you are looking for is temporarily unavailable. Please try again later.
You don't have permission to access this resource. You do not have permission to view this page.
Access denied. You are not authorized to access this page. Reference #1
You must be logged in to view this page. Please sign in to continue. Please log in again.
Your session has expired. Please sign in again to continue. Your session timed out due to inactivity.
The server encountered an internal error or misconfiguration and was unable to complete your request. Please contact the server administrator.
The server encountered an unexpected condition that prevented it from fulfilling the request. Request ID 1
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
The service is unavailable. The site is down for maintenance. The website is currently down for maintenance. We will be back soon.
The server did not respond in time. The upstream server did not respond in time. 504 Gateway Time-out. 408 Request Time-out.
502 Bad Gateway nginx. The proxy server received an invalid response from an upstream server.
Too many requests. You have been rate limited. Rate limit exceeded. Retry after 1 seconds.
This page isn't working. The site can't be reached. The connection was reset. The server refused to connect. The connection has timed out.
Checking your browser before accessing the site. This process is automatic. Ray ID
Checking if the site connection is secure. Verify you are human by completing the action below. Please complete the security check to access.
Sorry, you have been blocked. You are unable to access this site. Attention required!
Error establishing a database connection. Could not connect to the database server.
Connection failed: could not connect to server. SQL error: no such table.
There has been a critical error on this website. Please check your site admin email inbox for instructions.
Briefly unavailable for scheduled maintenance. Check back in a minute.
Oops! Something went wrong. Sorry, something went wrong. Please reload the page. If the problem persists, contact support.
An error occurred while processing your request. An unexpected error occurred. An unknown error has occurred. Please try again.
Error 404. Error 500. HTTP Status 404. HTTP Error 503. The service is unavailable.
Application error: a client-side exception has occurred. See the browser console for more information.
Whitelabel Error Page. This application has no explicit mapping for error, so you are seeing this as a fallback.
Server Error in Application. Runtime Error. An application error occurred on the server.
Traceback (most recent call last): File "<stdin>", line 1, in <module> KeyError: 'spam'
Traceback (most recent call last): File "main.py", line 1, in main ValueError TypeError IndexError AttributeError: 'str' object has no attribute 'name'
Fatal error: Uncaught exception thrown in index.php on line 1. Parse error: syntax error, unexpected end of file.
Exception in thread "main" java.lang.NullPointerException. Uncaught TypeError: Cannot read properties of undefined.
Exception: java.lang.IllegalStateException. Caused by: java.io.IOException. Failed to load the application context. ZeroDivisionError: division by zero.
Warning: mysqli_connect(): Access denied for user in index.php on line 1. Notice: Undefined variable in index.php on line 1. Allowed memory size exhausted.
Error 503 Backend fetch failed. Guru Meditation: XID 1. Varnish cache server. Service overloaded.
Request blocked. We can't connect to the server for this app or website at this time. Please wait while your request is being verified.
Access to this page has been denied because we believe you are using automated tools to browse the website.
Failed to load the resource. Failed to load content. The content could not be loaded. The file could not be loaded.
The link you followed has expired. This account has been suspended. This domain is for sale. No results found. 0 results.
Seite nicht gefunden. Fehler 404. Die angeforderte Seite wurde nicht gefunden. Die Seite konnte nicht geladen werden. Zurück zur Startseite.
Zugriff verweigert. Sie haben keine Berechtigung, auf diese Seite zuzugreifen. Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut. Ihre Sitzung ist abgelaufen.
Página no encontrada. Error 404. La página solicitada no existe. El contenido solicitado no está disponible. Ha ocurrido un error. No se pudo cargar el contenido. Su sesión ha caducado. Inicie sesión de nuevo. Inténtelo de nuevo más tarde. Acceso denegado.
Página não encontrada. Erro 404. Erro 500. Não foi possível carregar a página. Tente novamente mais tarde. Ocorreu um erro. Sua sessão expirou. Faça login novamente. O documento solicitado não está disponível. Acesso negado.
Page introuvable. Erreur 404. La page demandée n'existe pas. Une erreur est survenue. Veuillez réessayer plus tard. Accès refusé.
Pagina non trovata. Errore 404. Si è verificato un errore. Riprova più tardi.
"""

_STUB = """
Your text here. Your text goes here. Your content goes here. Your title goes here. Add your text here. Click here to edit.
Insert text here. Insert content. Insert title. Enter text. Type here. Write here.
Sample text. Example text. Dummy text. Filler text. Placeholder text. Placeholder content. Sample paragraph. This is a sample page. This is a placeholder.
This is an example of a page. Hello world! Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
Test post please ignore. This is a test. This is only a test message.
Coming soon. Under construction. This page is under construction. This site is under construction. Please check back later. Page intentionally left blank.
Content to follow. More to follow. To be completed. To be added. To be written. To be announced. To be determined. To be filled in.
TODO: write this section. TODO: write the text. TODO: add content. TODO: fill in.
The quick brown fox jumps over the lazy dog.
Beispieltext. Blindtext. Platzhalter. Hier steht Ihr Text. Text folgt. Inhalt folgt. Diese Seite befindet sich im Aufbau.
Texto de ejemplo. Texto de relleno. Su texto aquí. Próximamente. Página en construcción.
Texto de exemplo. Texto de preenchimento. Seu texto aqui. Em breve. Página em construção.
Texte d'exemple. Faux texte. Votre texte ici. Page en construction. Bientôt disponible.
"""

_DUMMY = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt. Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem. Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur? Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo voluptas nulla pariatur?
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa qui officia deserunt mollitia animi, id est laborum et dolorum fuga. Et harum quidem rerum facilis est et expedita distinctio. Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus, omnis voluptas assumenda est, omnis dolor repellendus. Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae. Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut perferendis doloribus asperiores repellat.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Maecenas sed diam eget risus varius blandit sit amet non magna. Nullam quis risus eget urna mollis ornare vel eu leo. Aenean lacinia bibendum nulla sed consectetur. Cras mattis purus sit amet fermentum. Donec ullamcorper metus auctor fringilla. Vivamus sagittis lacus vel augue laoreet rutrum. Integer posuere erat a ante venenatis dapibus. Curabitur tortor nibh porttitor ligula, lobortis cursus, vehicula mauris pretium, suspendisse potenti quisque facilisis volutpat.
"""

_WORDS = """
bla blah blubb yada foo bar baz qux quux
qwer qwert qwerty qwertz asdf asdfgh asdfasdf jkl jklö sdf sdfg zxcv yxcv hjkl uiop
tbd tba tbc todo fixme n/a xxx
...
"""

_FIELD = """
{{name}} {%= name %} {% name %} <%= name %> <% name %> ${name} #{name} $[name] [[name]] <<name>> «name» %(name)s %%name%% @@name@@ __NAME__ TBD_NAME ____
[insert name here] [insert name name name name here] [insert name name name name] [enter name here] [enter name name name name here] [enter name name name name] [enter name] [fill in name] [fill in name name name name] [your name here] [your name] [add name here] [type name here] [name here]
[hier name eintragen] [hier name name name name eintragen] [name einfügen] [name eingeben] [bitte name ergänzen] [insertar name aquí] [insertar name] [insertar name name name name] [introduzca name] [inserir name aqui] [inserir name] [inserir name name name name] [preencher name] [insérer name ici] [insérer name] [insérer name name name name] [saisir name] [inserire name qui]
<name> {name} [NAME]
"""

#: Residue of the labelled fit part, the 10,000 documents of scale 0.1, that the public texts leave
#: below the thresholds: 4 texts, of at most 40.
_FITTED = """
Scripts must be allowed for the waveform canvas to load. Enable cookies and scripts, then refresh.
The waveform cannot be drawn without script support.
Too many requests (429). Slow down and retry in 120 seconds.
JavaScript is disabled in your browser. Turn it on and reload the ECG viewer.
"""

_FURNITURE = """
Home About Contact Help Search Menu News Blog Shop Products Services Support FAQ Reports Login Log in Log out Sign in Sign up Register Account My account Settings Language English Deutsch Español Français Português
Back to top. Skip to main content. Privacy policy. Terms of use. Terms of service. Imprint. Cookie settings. Accessibility. Sitemap. All rights reserved. Powered by
Startseite Über uns Kontakt Hilfe Suche Anmelden Impressum Datenschutz Inicio Contacto Ayuda Buscar Iniciar sesión Início Contato Ajuda Entrar Accueil Aide Connexion
©
"""


def _lines(kind: str, text: str) -> list[tuple[str, str]]:
    return [(kind, line) for line in text.strip().splitlines()]


EXEMPLARS: list[tuple[str, str]] = [
    *_lines("notice", _NOTICE),
    *_lines("notice", _FITTED),
    *_lines("error", _ERROR),
    *[("error", f"{s.value} {s.phrase}. {s.description}.") for s in HTTPStatus if s.value >= 400],
    *_lines("stub", _STUB),
    *_lines("dummy", _DUMMY),
    *_lines("words", _WORDS),
    *_lines("field", _FIELD),
    *_lines("furniture", _FURNITURE),
]

#: Names in angle brackets that are mark-up or what programs print, not template fields.
MARKUP = frozenset(
    "a abbr article aside b big blockquote body br button caption center code col dd del div dl dt em embed figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main mark meta nav noscript object ol option p param pre q s samp script section select small source span strike strong style sub sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video".split()
    + "module lambda stdin stdout stderr string listcomp genexpr anonymous unknown none null nil eof".split()
)

#: Bracketed upper-case words that logs begin with or editors leave, not template fields.
LEVELS = frozenset("INFO WARN WARNING ERROR DEBUG TRACE FATAL NOTE OK FAIL PASS SKIP SIC REDACTED EDIT".split())
