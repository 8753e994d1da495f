"""Residue phrases that are neither seeds nor taken from the given documents.

FIRST and SECOND are older than the present seeds and were known when these were written; THIRD was written after the first
templates, which found 32 of its 34; templates added later were written with that count, not the misses, known. PROSE mentions such things in texts of its own.
"""

FIRST = (
    "Oops! We can't find the page you are looking for. It may have been moved or deleted.",
    "Sorry, this album cannot be displayed at the moment. Please refresh the page or contact support.",
    "This link is broken or has expired.",
    "We're having trouble connecting to the database right now.",
    "You are not authorised to open this folder.",
    "The upload failed because the file is too large.",
    "Connection refused by the remote host.",
    "The service is overloaded. Wait a moment before you try again.",
    "Hệ thống gặp sự cố, xin quay lại sau ít phút.",
    "Liên kết này không còn hoạt động.",
    "Bạn cần được cấp quyền để mở tệp này.",
    "Kết nối tới máy chủ bị gián đoạn.",
    "No se pudo abrir el archivo solicitado.",
    "El enlace ya no funciona o ha sido eliminado.",
    "No tiene permiso para abrir esta carpeta.",
    "El servidor no responde. Espere unos minutos.",
    "You must turn on JavaScript and cookies in order to use this photo portal.",
    "This application won't work unless scripting is allowed.",
    "Cookies are blocked in your browser, so we can't sign you in.",
    "Please wait while we verify your browser.",
    "Complete the captcha to prove you're a person.",
    "By using this website you agree to our use of cookies.",
    "Disable your script blocker and refresh this page.",
    "Trang web này dùng cookie để ghi nhớ lựa chọn của bạn.",
    "Cần bật JavaScript thì ứng dụng mới chạy được.",
    "Đang kiểm tra trình duyệt của bạn, xin chờ giây lát.",
    "Xác nhận bạn không phải là người máy.",
    "Este sitio utiliza cookies propias y de terceros.",
    "Debe habilitar JavaScript para usar la aplicación.",
    "Estamos comprobando su navegador, espere un momento.",
    "Demuestre que no es un robot.",
    "The text of this section will be supplied later by the editor.",
    "Write a short description of the tray here.",
    "This page is intentionally left blank.",
    "Details to follow.",
    "Dummy text for layout purposes only.",
    "blah blah blah blah",
    "More information will be added shortly.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Phần này sẽ được bổ sung sau.",
    "Viết mô tả khay vào đây.",
    "Văn bản giữ chỗ.",
    "Thông tin sẽ có trong thời gian tới.",
    "El contenido de esta sección se añadirá más adelante.",
    "Escriba aquí una breve descripción.",
    "Página en construcción.",
    "Pendiente de redactar.",
)
SECOND = (
    "This photo could not be loaded.",
    "Oh no, our servers are having a bad day. Come back in an hour.",
    "You need a higher access level to read this report.",
    "Ảnh này không còn tồn tại trên hệ thống.",
    "Máy chủ không phản hồi, thử lại sau.",
    "Vaya, algo salió mal. Recargue la página.",
    "No hay conexión con la base de datos.",
    "HTTP 410: the resource is gone.",
    "The gallery uses scripts that your browser has blocked.",
    "Set your browser to accept cookies, then sign in.",
    "Hold on while we make sure you are a real visitor.",
    "Bật cookie trong trình duyệt để đăng nhập.",
    "Trang sẽ mở sau khi kiểm tra trình duyệt xong.",
    "Sin JavaScript no se puede ver esta galería.",
    "Guardamos cookies en su dispositivo para recordar sus preferencias.",
    "We will write this part next week.",
    "Put the summary of the session here.",
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis.",
    "Chưa viết, sẽ bổ sung.",
    "Ghi mô tả lô hàng tại đây.",
    "Aquí irá el resumen de la sesión.",
    "Falta el texto de esta nota.",
    "Notes to come.",
)
THIRD = {
    "error, English": (
        "That didn't work. Give it another go in a bit.",
        "We can't reach the image store just now.",
        "Your upload was interrupted before it finished.",
        "Looks like this folder went missing.",
        "The report you want was taken offline last year.",
        "You'll need an account with editor rights for that.",
    ),
    "error, Vietnamese": ("Không mở được album, thử lại lần nữa nhé.", "Mạng đang chập chờn, dữ liệu chưa tải xong.", "Tệp bị hỏng nên không xem được."),
    "error, Spanish": ("La carpeta que pidió fue borrada.", "Algo falló al guardar los cambios.", "Se perdió la conexión, vuelva a cargar."),
    "notice, English": ("Scripts are needed for the photo viewer to run.", "Your privacy matters: choose which cookies we may set.", "Let us check that a person is visiting.", "Update your browser to open this gallery."),
    "notice, Vietnamese": ("Ứng dụng xem ảnh cần có JavaScript.", "Trang lưu cookie trên máy của bạn, bấm đồng ý để đi tiếp.", "Chờ chút, hệ thống đang xác minh kết nối."),
    "notice, Spanish": ("El visor de fotos necesita scripts para funcionar.", "Elija qué cookies acepta.", "Compruebe que es humano antes de entrar."),
    "filler, English": (
        "Somebody will write this up soon.",
        "Body copy goes in this box.",
        "Still blank, check back on Friday.",
        "Nothing has been entered for this lot.",
        "Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.",
        "Describe the crate in this field.",
    ),
    "filler, Vietnamese": ("Chỗ này sẽ viết sau.", "Đoạn chữ mẫu để xem bố cục.", "Chưa nhập ghi chú cho khay này."),
    "filler, Spanish": ("Este párrafo se redactará la próxima semana.", "Ponga aquí la nota de la bandeja.", "Texto simulado para la maqueta."),
}
PROSE = (
    "The report explains why the portal asks visitors to enable JavaScript, and which of the tablets in the packing hall had it switched off during the Monday round.",
    "We found the missing crate behind the shelf on Tuesday; the page of the log that describes it was torn, so the weights were copied from the second sheet.",
    "Người chụp ghi rằng trang báo lỗi hai lần trong buổi sáng, sau đó 24 quả cà chua được chụp lại dưới đèn trần và lưu cùng một nhóm.",
    "La revisora no pudo abrir la caja tres el lunes; la naranja de la bandeja siguiente perdió unos 30 gramos y mostraba moho cerca del tallo.",
    "The text on the label could not be read because the sticker was wet, and the reviewer asked for another frame of the same banana.",
)
