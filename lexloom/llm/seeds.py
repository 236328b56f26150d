"""A few sentences of each language, written for this library: a start for every model that is fitted here."""

# A few sentences per language, so that each has a model where the labelled rows are few.
SEED = {
    "ko": "이 문서는 시스템을 설치하고 운영하는 방법을 설명합니다. 오류가 발생하면 먼저 로그 파일을 확인하고 관리자에게 알려 주십시오. 회의에서는 다음 달까지 작업을 마치기로 결정했습니다. 사용자는 화면에서 결과를 볼 수 있지만 수정할 수는 없다. 어제 접수된 요청은 아직 처리되지 않았으며 담당자가 검토하고 있습니다. 그렇게 하면 문제가 해결될 때까지 기다릴 필요가 없습니다.",
    "en": "This document explains how the system is installed and operated. If an error occurs, first check the log file and then tell the administrator. The meeting agreed that the work should be finished by the end of next month. Users can see the results on the screen, but they cannot change them. The request that was received yesterday has not been processed yet, and somebody is looking into it. There is no reason to wait until the problem has been solved.",
    "ja": "この文書では、システムの設定と運用の方法を説明します。エラーが発生した場合は、まずログを確認してから管理者に連絡してください。会議では、来月末までに作業を終えることが決まりました。利用者は画面で結果を見ることができますが、変更することはできません。昨日受け付けた依頼はまだ処理されておらず、担当者が調べています。",
    "zh": "本文档说明如何安装和使用系统。如果发生错误，请先检查日志文件，然后通知管理员。会议决定在下个月底之前完成这项工作。用户可以在屏幕上看到结果，但是不能修改。昨天收到的请求还没有处理，负责人正在检查。因为问题已经解决了，所以没有必要再等待。",
    "de": "Dieses Dokument erklärt, wie das System eingerichtet und betrieben wird. Wenn ein Fehler auftritt, prüfen Sie zuerst die Protokolldatei und sagen Sie dann dem Verwalter Bescheid. In der Besprechung wurde beschlossen, dass die Arbeit bis zum Ende des nächsten Monats fertig sein soll. Die Benutzer können die Ergebnisse sehen, aber nicht ändern. Die Anfrage von gestern ist noch nicht bearbeitet worden.",
    "fr": "Ce document explique comment le système est installé et utilisé. Si une erreur se produit, vérifiez d'abord le journal, puis prévenez l'administrateur. La réunion a décidé que le travail devait être terminé avant la fin du mois prochain. Les utilisateurs peuvent voir les résultats à l'écran, mais ils ne peuvent pas les modifier. La demande reçue hier n'a pas encore été traitée et quelqu'un s'en occupe.",
    "es": "Este documento explica cómo se instala y se utiliza el sistema. Si se produce un error, compruebe primero el registro y avise después al administrador. En la reunión se acordó que el trabajo debía terminarse antes de que acabe el mes que viene. Los usuarios pueden ver los resultados en la pantalla, pero no pueden cambiarlos. La solicitud recibida ayer todavía no ha sido tratada y alguien la está revisando.",
    "pt": "Este documento explica como o sistema é instalado e utilizado. Se ocorrer um erro, verifique primeiro o registro e depois avise o administrador. Na reunião ficou decidido que o trabalho deve ser concluído até o fim do próximo mês. Os usuários podem ver os resultados na tela, mas não podem alterá-los. O pedido recebido ontem ainda não foi tratado e alguém está cuidando disso.",
}
