"""The small labelled table that the recogniser of personal data is trained from.

Rows are sentences with marked spans, made by filling the patterns below, written from everyday letters, forms and news and
not from any table of posts, with invented values: {P} a person's name,
{E} an email address, {T} a telephone number, {I} an identity number, {A} a street address, {N}, {L}, {B} and {X} what only
resembles them (a number or code, a place, a product, a handle). The filling is seeded, so the table is always the same.
"""

from __future__ import annotations

import random

# Given names, family-name characters and words that the filled patterns draw from.
GIVEN = (
    "Anna Maria Lucía Sofia Elena Clara Nadia Ingrid Astrid Freya Emma Julia Laura Beatriz Camille Chloé Elise Amélie Marta Paula Inés Carmen Teresa Rita Ana "
    "Sigrún Yuki Mei Aisha Fatima Olga Irina Katarina Jana Petra Greta Heidi Monika John James Peter Paul Owen Hugo Felix Lukas Jonas Tobias Anton Emil Oskar "
    "Diego Javier Pablo Luis Miguel Rui João Pedro Tiago Nuno Pavel Ivan Boris Sergei Marek Tomasz Pierre Luc Henri Marc Antoine Yves Ken Hiro Ali Omar Noah Liam"
).split()
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计成戴宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫简温闻裴陆翁荀甄曲封储靳邢井段富巫乌焦巴弓"
COMPOUND_SURNAMES = "欧阳 司空 上官 诸葛 司马 东方 皇甫 尉迟 公孙 慕容 令狐 宇文 长孙 司徒 夏侯 端木 南宫 独孤 轩辕 百里".split()
_GIVEN_ZH = "明华丽娜芳敏静伟强磊洋勇艳杰涛超秀英霞平刚桂兰予舟叙白知遥晚棠沐岑听澜若晗漪禾霁珩承屿思源子涵梓轩雨桐浩然一诺文博嘉怡欣妍"
_FAMILY_JA = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 朝比奈 長谷川 久保田 東海林 小野寺 五十嵐 白石 水無月 霧島 早乙女 月見里 綾小路 桜庭 風間".split()
_GIVEN_JA = "太郎 花子 健太 美咲 翔太 陽菜 大輔 朔也 透 美帆 奈々 直樹 由美 浩二 真央 拓也 千尋 和也 恵 莉子 悠斗 帆乃 朔太 透也 美帆乃".split()
_SYLLABLES = "bar bel bren cas dor dal fen fer gal gor han hol kel kor lan lin mar mor nor ok pel quis rav sal sar sten tan tav tol ur val van ver wel zel".split()
_TAILS = "ström berg hardt ova ani elle ente holt maren wick que vane torre sson ák ini ard eau ez íñez stadt qvarn reira nçal hauser".split()
_STREET = "Alder Brindle Cedar Dover Elm Ferry Garnet Harbour Iris Juniper Kings Larch Maple Needle Orchard Pine Quarry Ridge Salt Thorn Union Vine Willow York".split()
_STREET2 = "moor croft spur hurst field gate brook side mill wood stone bridge hill bank".split()
_PLACES = "Dunmore|Calverton|Westbrook|Port Avery|Millford|Norham|Sankt Veit|Lindau am See|Torfheim|Puerto Real|Villa Luz|Nava del Rey|Santa Olalla|Porto Alto|Vila Nova|Lagoa Verde|Saint-Omer|Montclair|Brissac|Port-Louis".split("|")
_PLACES_ZH = "青石县 望江区 云溪镇 临海港 北松城 石门新区 海棠岛 松林县 南桥街道 东湖高新区".split()
_PLACES_JA = "霧ヶ丘 東雲町 白樺台 みどり川 あかね野 桜坂市 青葉区".split()
_PRODUCTS = "Velora|Nordway|Brunel Loft|Oskar One|Hestra 8|Quarz GT|Tianq S7|Lumeva|Yunha Z|Model K|Kestrel 5|Volta E3".split("|")
_HANDLES = "garage voltage cabin torque commuter mileage winterrange plugin sedanfan kilowatt hatchback roadtrip".split()


#: Words that announce a value, by language and kind, and words before and after it; sentences are made from them by rule.
ANNOUNCED = {
    "en": {
        "P": "name|full name|contact|contact person|customer|applicant|holder|guest|patient|driver|witness|tenant", "E": "email|e-mail|mail|email address|mail address",
        "T": "phone|phone number|mobile|cell|telephone|tel|number|contact number|hotline", "A": "address|home address|delivery address|postal address|billing address|location",
        "I": "ID|ID number|ID card|social security number|SSN|national ID|identity number|document number|tax ID|insurance number",
    },
    "de": {
        "P": "Name|Ansprechpartner|Kunde|Kundin|Inhaber|Zeuge|Mieter|Fahrer", "E": "E-Mail|Mail|Mailadresse|E-Mail-Adresse", "T": "Telefon|Telefonnummer|Handy|Mobil|Tel|Nummer|Rückruf",
        "A": "Adresse|Anschrift|Lieferadresse|Wohnort|Standort", "I": "Ausweisnummer|Personalausweis|Ausweis|Sozialversicherungsnummer|Steuernummer|Ausweis-Nr.",
    },
    "fr": {
        "P": "nom|client|cliente|titulaire|témoin|locataire|interlocuteur", "E": "e-mail|courriel|mail|adresse mail", "T": "téléphone|numéro|portable|tél|mobile",
        "A": "adresse|domicile|adresse de livraison|lieu", "I": "numéro de sécurité sociale|numéro d'identité|carte d'identité|numéro de carte|matricule",
    },
    "es": {
        "P": "nombre|cliente|titular|testigo|inquilino|contacto", "E": "correo|email|correo electrónico|mail", "T": "teléfono|número|móvil|tel|celular",
        "A": "dirección|domicilio|dirección de entrega|lugar", "I": "DNI|NIE|número de identidad|documento|carné|cédula",
    },
    "pt": {
        "P": "nome|cliente|titular|testemunha|inquilino|contato", "E": "email|e-mail|correio|endereço de email", "T": "telefone|número|celular|telemóvel|tel",
        "A": "endereço|morada|endereço de entrega|local", "I": "CPF|NIF|RG|número de identidade|documento|cartão de cidadão",
    },
    "zh": {
        "Pz": "姓名|联系人|收件人|客户|车主|申请人|办理人|登记人|负责人", "E": "邮箱|电子邮箱|邮件|邮箱地址", "Tz": "电话|手机|手机号|联系电话|微信|微信号|手机微信|座机|号码",
        "Az": "地址|住址|家庭住址|收货地址|联系地址|位置", "Iz": "身份证|身份证号|身份证号码|证件|证件号|证件号码|证号",
    },
    "ja": {
        "Pj": "氏名|名前|お名前|担当者|連絡先|契約者", "E": "メール|メールアドレス|Eメール", "Tj": "電話|電話番号|携帯|連絡先|お電話", "Aj": "住所|所在地|お届け先|場所",
        "Ij": "マイナンバー|個人番号|番号|本人確認番号",
    },
}
_LED = {
    "en": {
        "P": "I am|This is|I spoke to|Ask for|Please contact|signed by|Regards,|Thanks,|Mr.|Mrs.|Ms|Dr.|the technician|our manager|the clerk|the owner|my neighbour|a customer called", "E": "Write to|Send it to|Mail me at|Forward everything to|Reply to|It goes to|Contact",
        "T": "Call|Ring|Phone|Dial|Text|Reach me on|Reach us at|Call me back on|You will find me under|Try", "A": "I live at|We live at|It stands at|Come to|Deliver it to|The shop is at|We met at|It happened at|parked at|towed from|moved to|born at",
        "I": "registered under|filed under ID|the number|my ID|with ID|under|under ID|paid with ID|ID in our files|on record as",
    },
    "de": {
        "P": "Ich bin|Ich heiße|Hier ist|Gruß,|Fragen Sie|Herr|Frau|der Techniker|die Beraterin|unser Kollege|mein Nachbar|gezeichnet", "E": "Schreiben Sie an|Bitte an|Schicken Sie es an|Antwort an", "T": "Rufen Sie an unter|Erreichbar unter|Bitte|Am besten|Wählen Sie",
        "A": "Ich wohne in der|Wir wohnen|Er steht in der|Lieferung an|Abzuholen|Treffpunkt|Das Büro ist in der|geparkt in der", "I": "eingetragen unter|unter der Nummer|mit Ausweis",
    },
    "fr": {
        "P": "Je suis|Je m'appelle|Ici|Demandez|Cordialement,|Monsieur|Madame|M.|Mme|le technicien|notre collègue|signé", "E": "Écrivez à|Envoyez tout à|Répondez à", "T": "Appelez le|Appelez-moi au|Joignable au|Rappelez au|Composez le",
        "A": "J'habite|J'habite au|Nous habitons|Garée au|Livrez au|Rendez-vous au|Le bureau est au", "I": "enregistré sous le|sous le numéro|avec la carte",
    },
    "es": {
        "P": "Soy|Me llamo|Aquí|Pregunten por|Un saludo,|Señor|Señora|Don|Doña|el técnico|nuestra compañera|firmado por", "E": "Escriban a|Envíen todo a|Respondan a", "T": "Llamen al|Llámenme al|Marquen el|Me encuentran en el",
        "A": "Vivo en|Vivimos en|Está en|Aparcado en|Entreguen en|La oficina está en", "I": "registrado con el|con el número|con documento",
    },
    "pt": {
        "P": "Sou|Chamo-me|Aqui é|Procurem|Abraço,|Senhor|Senhora|Sr.|Sra.|o técnico|a nossa colega|assinado por", "E": "Escrevam para|Enviem tudo para|Respondam a", "T": "Liguem para|Liguem para o|Me chamem no|Disquem",
        "A": "Moro na|Moro em|Moramos na|Está na|Parado na|Entreguem na|O escritório fica na", "I": "registrado com o|com o número|com documento",
    },
    "zh": {
        "Pz": "我是|我叫|本人|请找|经办人是|登记的是|这是|客服|技师|邻居|同事|签字的是", "E": "发到|请发|写信到|寄到|回复", "Tz": "请打|拨打|打|加微信|请拨|来电", "Az": "住在|我家在|送到|停在|寄到|公司在|店在", "Iz": "证件是|编号是|登记的证件",
    },
    "ja": {"Pj": "担当は|私は|こちらは|受付は", "E": "送り先は|返信は", "Tj": "電話は|携帯は", "Aj": "車は|会社は|家は|店は", "Ij": "個人番号は|登録は"},
}
_ACTED = {
    "en": "called|paid the bill|signed the form|visited us|wrote back|is waiting|has left|bought it|moved out|complained", "de": "hat angerufen|hat bezahlt|hat unterschrieben|wartet|kam vorbei|wohnt hier", "fr": "a appelé|a payé|a signé|attend|est passé|habite ici",
    "es": "llamó|pagó|firmó|espera|vino|vive aquí", "pt": "ligou|pagou|assinou|espera|veio|mora aqui", "zh": "来过|付了款|签了字|打了电话|在等", "ja": "さんが来ました|さんが払いました|様が待っています",
}
_AFTER = {
    "en": ["", ".", " today.", " after work.", ", please.", ", thank you.", " and nobody came.", " before noon.", "; that is all.", " was kind.", " yesterday."], "de": ["", ".", ", danke.", " heute.", " ab acht Uhr.", ", bitte."],
    "fr": ["", ".", ", merci.", " ce soir.", ", s'il vous plaît."], "es": ["", ".", ", gracias.", " hoy.", ", por favor."], "pt": ["", ".", ", obrigado.", " hoje.", ", por favor."],
    "zh": ["", "。", "，谢谢。", "就可以。", "已经登记。", "，请核对。", "，麻烦了。", "，随时可以。", "先生。", "女士。"], "ja": ["", "。", "です。", "にあります。", "へお願いします。", "と申します。", "さんです。"],
}
_WHAT = {
    "en": ("order", "tracking number", "part", "batch", "invoice", "ticket", "case", "version", "build", "software", "firmware", "update", "release", "model", "serial number", "VIN", "flight", "reading", "reference"), "de": ("Bestellung", "Sendung", "Teil", "Vorgang", "Rechnung", "Version", "Auftrag", "Zähler"),
    "fr": ("commande", "colis", "pièce", "dossier", "facture", "version", "lot"), "es": ("pedido", "envío", "pieza", "caso", "factura", "versión", "lote"), "pt": ("pedido", "encomenda", "peça", "protocolo", "fatura", "versão", "lote"),
    "zh": ("订单", "订单号", "快递单号", "工单", "零件", "配件", "版本", "批次", "车架号", "流水号", "编号", "发票"), "ja": ("注文番号", "追跡番号", "部品", "受付番号", "バージョン", "請求書"),
}


# Ordinary Chinese words, among them many that begin with or hold a character that is also a family name.
_ORDINARY_ZH = (
    "简单 简短 简直 简介 高兴 高速 高温 提高 安全 安排 安装 方法 方面 方式 时间 时候 水平 水果 水管 金额 金属 常常 常见 车间 车站 白天 明白 温度 温和 温暖 于是 关于 由于 等于 对于 易于 祝福 黄金 马上 石头 江边 成为 完成 成本 和平 解决 应该 应当 反应 包括 包含 包装 连接 连续 "
    "华丽 平台 平时 公平 严重 严格 路上 道路 路边 向前 方向 云彩 花费 花园 计划 设计 统计 康复 健康 项目 事项 雷雨 顾客 顾问 照顾 孟夏 万一 千万 经常 支持 支付 管理 保管 程度 程序 过程 许多 也许 允许 何时 如何 任何 施工 实施 张开 紧张 纸张 孔洞 曹操 魏国 陶瓷 生姜 感谢 谢谢 多谢 邹城 比喻 柏油 水泵 窗户 "
    "文章 云端 苏醒 潘多拉 葛根 范围 规范 彭湃 郎中 韦编 昌盛 马路 树苗 凤凰 花钱 方便 俞允 任务 责任 信任 袁大头 柳树 鲍鱼 历史 唐诗 费用 免费 廉价 岑寂 薛涛 雷达 贺卡 汤圆 祝愿 元素 单元 罗列 毕竟 毕业 郝然 乌云 常温 乐观 快乐 音乐 于此 余额 其余 业余 元旦 卜算 顾虑 孟母 平均 黄色 穆然 萧条 尹始 "
    "姚明 邵武 汪洋 毛病 毛巾 戴上 宋体 庞大 熊猫 纪录 纪念 舒服 舒适 屈服 项链 祝贺 董事 梁柱 桥梁 杜绝 阮琴 蓝色 季节 季度 贾客 江湖 童年 颜色 郭外 梅花 盛大 林业 钟表 分钟 徐徐 邱壑 骆驼 高度 夏天 蔡邕 田地 樊笼 胡乱 凌晨 霍乱 虞美人 万能 柯达 管道 卢比 莫非 房间 干净 解释 丁香 邓林 单位 洪水 包裹 左右 石油 崔嵬 吉他 龚自珍"
).split()
# Units of measures by language.
_UNITS = {
    "en": "days hours weeks minutes years kilometres miles degrees percent posts calls times euros pieces people", "de": "Tage Tagen Stunden Wochen Minuten Jahre Kilometer Grad Prozent Mal Anrufe Euro Teile Leute",
    "fr": "jours heures semaines minutes ans kilomètres degrés fois appels euros pièces personnes", "es": "días horas semanas minutos años kilómetros grados veces llamadas euros piezas personas",
    "pt": "dias horas semanas minutos anos quilômetros graus vezes ligações euros peças pessoas", "zh": "天 小时 周 分钟 年 公里 度 次 个 元 件 人 条 批 月", "ja": "日 時間 週間 分 年 キロ 度 回 件 円 個 人 月",
}


def made_patterns() -> list[str]:
    """Sentences by rule: an announced value, a led-in value, lists of values, and numbers that are no personal data."""
    r = random.Random(11)
    out = []
    for lang, kinds in ANNOUNCED.items():
        dense = lang in ("zh", "ja")
        mine, colon, comma = {"en": "My {} is ", "de": "Meine {} ist ", "fr": "Mon {} est ", "es": "Mi {} es ", "pt": "O meu {} é ", "zh": "我的{}是", "ja": "{}は"}[lang], "：" if dense else ": ", "、" if lang == "ja" else "，" if dense else ", "
        gap = "" if dense else " "
        for kind, words in kinds.items():
            slot = f"{{{kind}}}"
            for w in words.split("|"):
                after = lambda: r.choice(_AFTER[lang])
                out += [mine.format(w) + slot + after(), w + colon + slot, w + gap + slot + after(), f"({w}{gap}{slot})", w.capitalize() + colon + slot + after()]
            for w in _LED[lang].get(kind, "").split("|"):
                out += [f"{w}{gap}{slot}{r.choice(_AFTER[lang])}" for _ in range(3)]
        slots = [f"{{{k}}}" for k in kinds]
        name, number = slots[0], slots[-1]
        for w in _ACTED[lang].split("|"):
            said = r.choice(ANNOUNCED[lang][number[1:-1]].split("|"))
            out += [f"{name}{gap}{w}{r.choice(_AFTER[lang])}", f"{name}{gap}{w}{comma}{said}{gap}{number}", f"{name}{gap}{w}{gap}({number})"]
        for _ in range(30):
            some = r.sample(list(kinds), r.choice((2, 2, 3)))
            said = [f"{r.choice(kinds[k].split('|'))}{r.choice((colon, gap))}{{{k}}}" if r.random() < 0.6 else f"{{{k}}}" for k in some]
            out.append(r.choice((comma, comma, " / ", " ", "; ")).join(said) + r.choice(_AFTER[lang]))
        out += [comma.join((slots[0], slots[3], slots[2])), comma.join((slots[0], slots[2]))]
        for w in _WHAT[lang]:
            out += [f"{w}{gap}{{N}}{r.choice(_AFTER[lang])}", f"{w.capitalize()}{colon}{{N}}{comma}{{N}}", f"{w}{gap}{{n}}{r.choice(_AFTER[lang])}", f"{w}{gap}{{N}}{comma}{{word{lang}}}"]
        out += [f"{{word{lang}}}"] * 150
        place = {"zh": "{Lz}", "ja": "{Lj}"}.get(lang, "{L}")
        for i in range(60):  # places and numbers among words are no addresses
            parts = [place, f"{{bare{lang}}}", r.choice(("{N}", "{n}", "{B}", "{X}")), f"{{bare{lang}}}"]
            out.append(gap.join(parts if i % 2 else parts[2:3] + parts[1:2] + parts[:1] + parts[3:]))
    return out


# Common words, of which meaningless lines are strung that hold no personal data.
_COMMON = {
    "en": "the of and a to in we you that it he was for on are as with they at be this from have or had by word but what some can out other were all there when up use your how said an each she which do their time if will way about many then them would like so these her long make thing see him two has look more day could go come did sound no most people over know water than call first who may down side been now find independent lab report meeting window garden station market customer team service update screen noise battery Monday March January Council Ministry Institute Committee Club Hotel Bank Express Center Group Press Office Sales Support",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde Zwei Drei Laut Nach Seit Viele Manche Nachbarn Entwurf Bericht Werkstatt Haus Straßenbahn Wetter Kollegen Kinder Schule Prozent Stunden Kilometer Montag März Freitag Gruppe Verein Bahnhof Fenster Garten Wasser Arbeit Antwort Frage Geschichte Zeitung Regierung Polizei Feuerwehr Kunden Teile Probleme Batterie Händler",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ils mais comme ou si leur deux été fait cette aussi tout nous sa même bien où sans peut tous ont entre autre après voiture maison école ville rapport équipe semaine lundi mars janvier bureau client service essai panne écran batterie Deux Trois Selon Depuis Pendant Après Merci Mairie Ministère Comité Club Banque Gare",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así coche casa escuela ciudad informe equipo semana lunes marzo enero oficina cliente servicio prueba avería pantalla batería modelo Dos Tres Según Desde Durante Después Ayuntamiento Ministerio Comité Club Banco Estación",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus carro casa escola cidade relatório equipe semana segunda março janeiro escritório cliente serviço teste falha tela bateria modelo Duas Três Segundo Desde Durante Depois Prefeitura Ministério Comitê Clube Banco Estação",
    "zh": "的 一 是 在 不 了 有 和 人 这 中 大 为 上 个 国 我 以 要 他 时 来 用 们 生 到 作 地 于 出 就 分 对 成 会 可 主 发 年 动 同 工 也 能 下 过 子 说 产 种 面 而 方 后 多 定 行 学 法 所 民 得 经 十 三 之 进 着 等 部 度 家 电 力 里 如 水 化 高 自 二 理 起 小 物 现 实 加 量 都 两 体 制 机 当 使 点 从 业 本 去 把 性 好 应 开 它 合 还 因 由 其 些 然 前 外 天 政 四 日 那 社 义 事 平 形 相 全 表 间 样 与 关 各 重 新 线 内 数 正 心 反 你 明 看 原 又 么 利 比 或 但 质 气 第 向 道 命 此 变 条 只 没 结 解 问 意 建 月 公 无 系 军 很 情 者 最 立 代 想 已 通 并 提 直 题 党 程 展 五 果 料 象 员 革 位 入 常 文 总 次 品 式 活 设 及 管 特 件 长 求 老 头 基 资 边 流 路 级 少 图 山 统 接 知 较 将 组 见 计 别 她 手 角 期 根 论 运 农 指 几 九 区 强 放 决 西 被 干 做 必 战 先 回 则 任 取 据 处 队 南 给 色 光 门 即 保 治 北 造 百 规 热 领 七 海 口 东 导 器 压 志 世 金 增 争 济 阶 油 思 术 极 交 受 联 什 认 六 共 权 收 证 改 清 己 美 再 采 转 更 单 风 切 打 白 教 速 花 带 安 场 身 车 例 真 务 具 万 每 目 至 达 走 积 示 议 声 报 斗 完 类 八 离 华 名 确 才 科 张 信 马 节 话 米 整 空 元 况 今 集 温 传 土 许 步 群 广 石 记 需 段 研 界 拉 林 律 叫 且 究 观 越 织 装 影 算 低 持 音 众 书 布 复 容 儿 须 际 商 非 验 连 断 深 难 近 矿 千 周 委 素 技 备 半 办 青 省 列 习 响 约 支 般 史 感 劳 便 团 往 酸 历 市 克 何 除 消 构 府 称 太 准 精 值 号 率 族 维 划 选 标 写 存 候 毛 亲 快 效 斯 院 查 江 型 眼 王 按 格 养 易 置 派 层 片 始 却 专 状 育 厂 京 识 适 属 圆 包 火 住 调 满 县 局 照 参 红 细 引 听 该 铁 价 严",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について せ だっ その後 できる それ う ので なお のみ でき き つ における および いう さらに でも ら たり 会社 車 電池 画面 故障 報告 検査 販売店 更新 週間 時間 学校 天気 映画 電車 返事 仕事 問題 質問 駅 公園",
}


#: Patterns by language; the last group are whole fields such as an author's.
PATTERNS = """
Hi, this is {P}, my number is {T}.
Hello, {P} here. Could you ring me back on {T} before noon?
I am {P}, I live at {A} and I would like to cancel.
My name is {P} and my email is {E}.
My name is {P}, my phone is {T} and my address is {A}.
Name: {P}, Phone: {T}, Email: {E}
Name: {P}; Address: {A}; Tel. {T}
{P} | {E} | {T}
{P}, {A}
{P}, {T}
{P} ({E}) wrote on Tuesday.
Dear Mr. {P}, your parcel was left at {A}.
Dear Ms {P}, thank you for your letter.
Kind regards, {P}
Best, {P}, {T}
Sincerely yours, {P}, {A}
Please forward the invoice to {E}, thanks.
Drop me a line: {E}
You can email {E} or text {T}.
Any questions? {E}
Mail: {E} Tel: {T}
Call {T} for a quote.
Text me at {T}.
My cell is {T}, evenings only.
Fax {T}, phone {T}.
{T} is my number.
Reach the night desk on {T}.
My social security number is {I}.
SSN: {I}
Her SSN ({I}) was on the form.
Please update the tax file, ID {I}.
National insurance and ID number {I} were attached.
Passport holder {P}, ID number {I}, arrived on Friday.
ID {I} belongs to {P}.
Deliver to {A} please.
The flat at {A} is for rent.
We moved from {A} to {A} last spring.
Our office is at {A}, second floor.
Pick it up at {A}, ask for {P}.
Yesterday {P} visited us in {L}.
The nurse, {P}, was very kind.
A plumber named {P} fixed the tap.
According to {P}, the museum closes at six.
Tenant {P} of {A} paid the rent.
{P} and {P} got married in {L}.
user: I am {P}, my mail address is {E}
user: can you text {T}?
assistant: I have noted {A} as the address.
assistant: {P} will answer from {E}.
system: account of {P}, telephone {T}
Thank you {X}, that helped.
As {X} said, it works.
cc {X} {X}
Your order {N} ships tomorrow.
Order number {N}, parcel {N}.
Tracking number {N} says delivered.
Serial no. {N}, part no. {N}.
Flight {N} was late.
Ticket {N} was closed without an answer.
Reference: {N}.
Invoice {N} is due on 12 May.
Receipt {N}, total 48.20.
Version {N} came out on 3 March 2024.
The app crashed after version {N}.
Error {N} appears on the screen.
Vehicle {N} passed the test.
The counter reads {N}.
The library in {L} opens at nine, the one in {L} at ten.
It rained for 14 hours in {L} and the river rose by 30 centimetres.
The mayor of {L} and the City Council met on Thursday.
The train from {L} to {L} takes 2 hours.
She bought a {B} in {L} for 12,500 euros.
The {B} costs 899 and weighs 12 kilos.
The Ministry of Health and the Red Cross opened a clinic in {L}.
Two teams from {L} played 3:2 on Sunday.
The Northern Star Hotel has 120 rooms.
In March 2019 the White House answered 350 letters.
The recipe needs 200 grams of flour and 3 eggs.
My sister's {B} broke twice this year, and the shop would not help.
Does anybody know a good dentist near {L}?
I have been waiting for three weeks and nobody answers.
The film was long, the music was lovely, and the end surprised us.
Customer Service was friendly, but the Help Desk never called back.
Read more at https://www.example.org/{n}/{n} today.
Guten Tag, mein Name ist {P}, Telefon {T}.
Hier schreibt {P}, meine Nummer ist {T}.
Ich wohne in der {A}.
Ich bin {P} und wohne {A}.
Mit freundlichen Grüßen, {P}
Sehr geehrter Herr {P}, Ihr Paket liegt bereit.
Sehr geehrte Frau {P}, wir rufen Sie unter {T} zurück.
Schreiben Sie bitte an {E}.
E-Mail: {E}, Telefon: {T}
Rückruf erbeten: {T}
Sie erreichen mich unter {T}.
Meine Ausweisnummer lautet {I}.
Personalausweis Nr. {I}, ausgestellt in {L}.
Lieferadresse: {A}
Unser Büro liegt {A}.
Der Hausmeister {P} hat den Schlüssel.
Meine Ärztin ist {P} aus {L}.
Bestellnummer {N}, bitte prüfen.
Ihre Sendung {N} ist unterwegs.
Rechnung {N} vom 3. Mai ist bezahlt.
Ersatzteil {N} kommt nächste Woche.
Seit Version {N} stürzt das Programm ab.
Zählerstand {N}.
Danke {X}, das hat geholfen.
Die Bücherei in {L} öffnet um neun Uhr.
In {L} regnete es 14 Stunden, und die Elbe stieg um 30 Zentimeter.
Der Zug von {L} nach {L} braucht zwei Stunden.
Das Rote Kreuz und die Stadtwerke haben in {L} ein Fest gefeiert.
Der {B} kostet 899 Euro und wiegt 12 Kilo.
Ich warte seit drei Wochen auf eine Antwort vom Kundendienst.
Weiß jemand, ob die Apotheke am Sonntag offen hat?
Am Montag war die Werkstatt geschlossen, am Dienstag auch.
Bonjour, je suis {P}, mon numéro est le {T}.
Je m'appelle {P} et j'habite {A}.
Je m'appelle {P}, mon téléphone est le {T}.
Cordialement, {P}
Chère Madame {P}, votre colis est arrivé.
Monsieur {P} vous rappellera au {T}.
Écrivez à {E}, s'il vous plaît.
Mon adresse : {A}
Livraison au {A}, deuxième étage.
Numéro de sécurité sociale : {I}
Ma carte porte le numéro {I}.
Contactez {P} ({E}) ou {T}.
Le gardien, {P}, a les clés.
Numéro de commande {N}, merci de vérifier.
Votre colis {N} est en route.
La facture {N} est payée.
Depuis la mise à jour {N}, l'application plante.
Référence {N}, pièce {N}.
Merci {X}, cela m'a aidé.
La bibliothèque de {L} ouvre à neuf heures.
À {L}, il a plu pendant 14 heures.
Le train de {L} à {L} met deux heures.
La Croix-Rouge et la mairie de {L} ont ouvert un centre.
Le {B} coûte 899 euros et pèse 12 kilos.
J'attends depuis trois semaines et personne ne répond.
Quelqu'un connaît-il un bon dentiste près de {L} ?
Hola, soy {P}, mi número es el {T}.
Mi nombre es {P} y vivo en {A}.
Me llamo {P}, mi correo es {E}.
Un saludo, {P}
Estimada señora {P}: su paquete ha llegado.
El señor {P} le llamará al {T}.
Escriban a {E}, por favor.
Mi teléfono: {T}
Mi dirección es {A}.
Entrega en {A}, segundo piso.
Mi número de identidad es {I}.
DNI: {I}
El portero, {P}, tiene las llaves.
Número de pedido {N}, revisen por favor.
Su paquete {N} está en camino.
La factura {N} está pagada.
Desde la actualización {N} la aplicación se cierra.
Referencia {N}, pieza {N}.
Gracias {X}, me sirvió.
La biblioteca de {L} abre a las nueve.
En {L} llovió durante 14 horas y subió el río.
El tren de {L} a {L} tarda dos horas.
La Cruz Roja y el ayuntamiento de {L} abrieron un centro.
El {B} cuesta 899 euros y pesa 12 kilos.
Llevo tres semanas esperando y nadie contesta.
¿Alguien conoce un buen dentista cerca de {L}?
Olá, sou {P}, o meu número é {T}.
O meu nome é {P} e moro em {A}.
Chamo-me {P}, o meu email é {E}.
Cumprimentos, {P}
Cara senhora {P}, a sua encomenda chegou.
O senhor {P} vai ligar para {T}.
Escrevam para {E}, por favor.
O meu telefone: {T}
A minha morada é {A}.
Entrega na {A}, segundo andar.
O número do meu CPF é {I}.
CPF: {I}
O porteiro, {P}, tem as chaves.
Número do pedido {N}, verifiquem por favor.
A sua encomenda {N} está a caminho.
A fatura {N} está paga.
Desde a atualização {N} o aplicativo fecha.
Referência {N}, peça {N}.
Obrigado {X}, ajudou muito.
A biblioteca de {L} abre às nove.
Em {L} choveu durante 14 horas e o rio subiu.
O comboio de {L} para {L} demora duas horas.
A Cruz Vermelha e a câmara de {L} abriram um centro.
O {B} custa 899 euros e pesa 12 quilos.
Espero há três semanas e ninguém responde.
Alguém conhece um bom dentista perto de {L}?
您好，我是{Pz}，手机{Tz}。
我的名字是{Pz}，住在{Az}。
收件人{Pz}，地址{Az}，电话{Tz}。
收货人：{Pz}，{Tz}，{Az}
姓名：{Pz}，身份证：{Iz}
身份证号码是{Iz}。
证件号{Iz}，办理人{Pz}。
请发邮件到{E}。
我的邮箱是{E}，手机号是{Tz}。
有事打我电话{Tz}，谢谢。
加微信{Tz}。
请把合同寄到{Az}。
我家在{Az}，离地铁很近。
{Pz}老师明天来上课。
{Pz}女士昨天到{Lz}看房。
{Pz}先生已经付款。
护士{Pz}很耐心。
此致敬礼，{Pz}
联系{Pz}，电话{Tz}，邮箱{E}。
assistant: 已记录{Pz}的地址：{Az}
user: 我叫{Pz}，我的电话是{Tz}
订单编号{N}，请核对。
快递{N}已经发出。
发票{N}已付款。
更新到{N}之后，软件一打开就退出。
参考编号{N}，零件{N}。
水表读数{N}。
谢谢{X}，很有帮助。
{Lz}的图书馆九点开门。
{Lz}下了十四个小时的雨，河水涨了三十厘米。
从{Lz}到{Lz}坐火车要两个小时。
红十字会在{Lz}开了一家诊所。
{B}的价格是899元，重12公斤。
我等了三个星期，没有人回复。
请问{Lz}附近有好的牙医吗？
昨天晚上电影很长，音乐很好听，结局让大家很意外。
老师说明天考试，同学们都在复习功课。
周末天气不错，一家人去公园散步，还吃了火锅。
公司决定今年不再招人，部门经理没有解释原因。
医院通知病人改到下周二复查，费用不变。
这家饭店的服务员态度一般，菜倒是挺新鲜。
市场上的苹果每斤八块钱，比上个月贵了两成。
专家认为这项研究还需要更多数据支持。
工程师检查了三遍，也没有发现问题出在哪里。
经过五个月的施工，大桥终于通车了。
はじめまして、{Pj}です。電話番号は{Tj}です。
私は{Pj}といいます。{Aj}に住んでいます。
氏名：{Pj}、電話：{Tj}、住所：{Aj}
お届け先は{Aj}、{Pj}様です。
メールアドレスは{E}です。
{E}までご連絡ください。
{Tj}までお電話ください。
私の個人番号は{Ij}です。
担当は{Pj}、内線ではなく{Tj}へお願いします。
{Pj}先生が明日いらっしゃいます。
{Aj}へ配達してください。
注文{N}を確認してください。
荷物{N}は発送済みです。
請求書{N}は支払い済みです。
更新{N}のあと、アプリが落ちます。
{X}さんのおかげで助かりました。
{Lj}の図書館は九時に開きます。
{Lj}では十四時間も雨が降り、川の水が増えました。
{Lj}から{Lj}まで電車で二時間かかります。
{B}の値段は899円で、重さは12キロです。
三週間待っていますが、返事がありません。
週末は天気がよかったので、家族で公園を散歩しました。
会社は今年の採用をやめると発表しました。
映画は長かったけれど、音楽がとてもよかったです。
""".strip().split("\n")
PATTERNS += made_patterns()
FIELDS = ("{P}", "{P}", "{P}", "{P}", "{Pz}", "{Pz}", "{Pz}", "{Pz}", "{Pz}", "{Pj}", "{Pj}", "{E}", "{E}", "{T}", "{T}", "{Tz}", "{h}", "{h}", "{h}", "{h}", "{z}", "{z}", "{z}", "{z}", "{z}", "{j}", "{j}")
_NICK_ZH = "周末跑车 老司机笔记 夜里充电 城北提车 理性买车 小电驴日常 慢慢开车 冬天续航 电车日记 通勤路上 山路十八弯 爱车一族 换电达人 等等党员 静静看车 阿强说车 大胖爱充电 提车记录 安静的车主 高速巡航 江边看车 林间小路 金色方向盘 马路杀手 白天不开车 云上充电 花花世界 时光慢递 明天提车 平安出行".split()
_NICK_JA = "週末ドライブ 充電日記 電費メモ 夜のドライブ 通勤メモ 車好き 冬の電費 高速日記".split()


class Filler:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, form: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "9" else c for c in form)

    def family(self) -> str:
        r = self.r
        s = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2)))) + r.choice(_TAILS)
        s = s[:1].upper() + s[1:]
        return r.choice(("de la ", "de la ", "de la ", "van ", "O'", "da ", "von ", "d'", "Mc")) + s if r.random() < 0.25 else s

    def value(self, kind: str) -> str:
        r, d = self.r, self.digits
        if kind == "P":
            g, f = r.choice(GIVEN), self.family()
            if r.random() < 0.12:
                g += f" {r.choice('ABCDEFGHJKLMPRST')}."
            s = f"{f}, {g}" if r.random() < 0.15 else f"{g} {f}"
            return s.upper() if (x := r.random()) < 0.1 else s.lower() if x < 0.2 else s
        if kind == "Pz":
            return (r.choice(COMPOUND_SURNAMES) if r.random() < 0.2 else r.choice(SURNAMES)) + "".join(r.sample(_GIVEN_ZH, r.choice((1, 2, 2))))
        if kind == "Pj":
            return r.choice(_FAMILY_JA) + r.choice(("", "", " ", "　")) + r.choice(_GIVEN_JA)
        if kind == "E":
            user = r.choice((f"{r.choice('abcdefghjklmnoprstuw')}.{self.family().lower().replace(' ', '').replace(chr(39), '')}", f"{self.family().lower().replace(' ', '').replace(chr(39), '')}{d('99')}", f"owner{d('9999')}", f"ev+{r.choice(_SYLLABLES)}{r.choice(_SYLLABLES)}", f"{r.choice(_SYLLABLES)}{r.choice(_SYLLABLES)}_ev", f"{r.choice(GIVEN).lower()}.{r.choice(_SYLLABLES)}"))
            host = r.choice(("example.com", "example.org", "example.net", "mail.example.com", "post.example.org", "kfz.example.net", "shop-mail.example.de", "qq.example.cn"))
            form = r.random()
            if form < 0.6:
                s = f"{user}@{host}"
            elif form < 0.68:
                s = f"{user}＠{host}"
            elif form < 0.76:
                s = f"{user} @ {host}"
            elif form < 0.84:
                s = f"{user} (at) {host}"
            elif form < 0.9:
                s = f"{user} [at] {host}"
            else:
                s = f"{user} at {host.replace('.', ' dot ')}"
            return s.upper() if r.random() < 0.08 else s
        if kind == "T":
            return d(r.choice(("+1 415 555 0199", "(212) 555-0199", "212-555-0199", "415.555.0199", "2125550199", "07700 900999", "+44 7700 900999", "020 7946 0999", "(030) 23125-999", "030 23125 999", "+49 30 23125999", "030/23125999", "01 99 00 99 99", "+33 1 99 00 99 99", "0199009999", "555 000 999", "555-000-999", "+34 555 000 999", "555000999", "11 900009999", "(11) 90000-9999", "+55 11 90000-9999", "11 90000 9999", "090-0000-9999")))
        if kind == "Tz":
            s = d(r.choice(("14000009999", "140 0000 9999", "140-0000-9999", "+86 140 0000 9999", "(+86)14000009999", "+8614000009999", "13999999999", "010-99999999", "0571-9999 9999")))
            return s.translate({ord(c): ord(c) + 0xFEE0 for c in "0123456789"}) if r.random() < 0.12 else s
        if kind == "Tj":
            return d(r.choice(("090-0000-9999", "(090)0000-9999", "09000009999", "03-0000-9999", "+81 90 0000 9999", "090 0000 9999", "+81-90-0000-9999")))
        if kind == "I":
            return d(r.choice(("999-99-9999", "999 99 9999", "999999999", "999999999", "999999999", "999-99-9999", "L99999 999 999", "L99999999", "99 999999999", "99 999 999 999", "99999999999", "9 99 99 99 999 999", "9999999999999", "9 99 99 99 999 999 99", "000.999.999-99", "00099999999", "999.999.999-99", "99999999Z", "99999999-H", "X9999999L", "99.999.999-K")))
        if kind == "Iz":
            return d(r.choice(("999999199909099999", "99999919990909999X", "999999 19990909 9999", "999999 19990909 999X", "999999-19990909-9999", "999999200009099999")))
        if kind == "Ij":
            return d(r.choice(("9999 9999 9999", "999999999999", "9999-9999-9999")))
        if kind == "A":
            n, m = r.randint(1, 1300), r.randint(1, 30)
            name = r.choice(_STREET) + r.choice(("", r.choice(_STREET2)))
            if r.random() < 0.3:
                name += f" {r.choice(_STREET)}"
            low = name.lower()
            s = r.choice((
                f"{n} {name} {r.choice(('Ave', 'Avenue', 'Street', 'St.', 'St', 'Lane', 'Drive', 'Road', 'Rd', 'Ct', 'Court', 'Blvd', 'Way', 'Place'))}" + r.choice(("", "", f", Apt {m}", f" #{m}", f", Unit {m}B", f", Suite {m}", f", Flat {m}")),
                f"{n} {r.choice(('Old', 'New', 'North', 'East'))} {name} {r.choice(('St.', 'Road', 'Lane'))}" + r.choice(("", f", Unit {m}B", f" #{m}")),
                f"{name}{r.choice(('straße', 'strasse', 'weg', 'gasse', 'allee', 'platz', 'ufer'))} {m}" + r.choice(("", f", {d('00999')} {name}hofen", "a")),
                f"{r.choice(('Am', 'An der', 'Im', 'Zum'))} {name}{r.choice(('graben', 'bach', 'hof', 'tor', 'markt'))} {m}" + r.choice(("", f", {d('00999')} {name}dorf")),
                f"{m} {r.choice(('rue', 'avenue', 'boulevard', 'chemin', 'place', 'impasse', 'quai', 'allée'))} {r.choice(('de la', 'des', 'du', 'de', 'Saint'))} {name}" + r.choice(("", f", {d('99999')} {name}ville", f", bât. {m % 5 + 1}")),
                f"{n}{r.choice(('', ' bis', ' ter'))} {r.choice(('rue', 'avenue', 'chemin', 'allée', 'impasse'))} {r.choice(('du', 'des', 'de la', 'de'))} {r.choice(('Vieux-', 'Trois-', 'Grand-', ''))}{name}",
                f"{m} bis, rue {name}", f"{r.choice(('Calle', 'C/', 'Avda.', 'Av.', 'Avenida', 'Plaza', 'Camino', 'Paseo'))} {r.choice(('', 'de ', 'del ', 'de la '))}{name}{r.choice((' ', ', '))}{n}" + r.choice(("", f", {m}º B", f", piso {m}", f", {m}º {m % 4}ª", ", bajo")),
                f"{r.choice(('Rua', 'R.', 'Av.', 'Avenida', 'Travessa', 'Alameda', 'Largo', 'Praça'))} {r.choice(('', 'do ', 'da ', 'das '))}{name}{r.choice((' ', ', '))}{n}" + r.choice(("", f", apto {m}", f", {m}º andar", f", ap. {m}")),
            ))
            return s.replace(name, low) if r.random() < 0.05 else s
        if kind == "Az":
            n, m = r.randint(1, 200), r.randint(1, 20)
            road = "".join(r.sample("望江松影听雨溪东湖篱明月清风长安和平人民中山解放建设", 2)) + r.choice(("路", "街", "巷", "大道", "弄", "胡同"))
            return r.choice(_PLACES_ZH) + road + f"{n}{r.choice(('号', '号', '号', '弄', '号院'))}" + r.choice(("", f"{m}栋{m}02室", f"{m}单元501", f"{chr(65 + m % 6)}座{m}层", f"{m}号楼", f"{m}幢{m}01"))
        if kind == "Aj":
            n, m = r.randint(1, 9), r.randint(1, 30)
            return r.choice(_PLACES_JA) + r.choice(("北町", "南町", "中町", "本町", "駅前", "")) + r.choice((f"{n}丁目{m}-{n}", f"{n}-{m}-{n}", f"{n}丁目{m}番地", f"{n}丁目{m}番{n}号")) + r.choice(("", "", f" {m}01号室"))
        if kind == "N":
            return d(r.choice(("T009999999", "SO999999999", "EV999999999", "SF9999999999999", "9999-999-A", "9999-999-C", "999999999", "8.29.9", "19.29.39.19", "9999999", "WVW9X9Z9KA9999999", "LSV999AB9C9999999", "INV-2024-99999", "#99999", "99999", "N9XP999D", "K9E9F9P9", "WRR9U9B")))
        if kind == "L" and r.random() < 0.7:
            town = r.choice(_STREET) + r.choice("brae ington gate row field wick mere brook ton ford".split())
            return r.choice((town, town, f"Port {town}", f"{town} Bay", f"{town} Point", f"Les {town}s", f"{town}-sur-Mer", f"Bad {town}", f"Santa {town}", f"Villa {town}", f"Puerto {town}", f"{town} Baja", f"Vila {town}", f"Porto {town}", f"Nava del {town}", f"São {town} do Rio"))
        if kind in ("L", "Lz", "Lj"):
            return r.choice({"L": _PLACES, "Lz": _PLACES_ZH, "Lj": _PLACES_JA}[kind])
        if kind == "B":
            return r.choice(_PRODUCTS)
        if kind == "X":
            return "@" + self.value("h")
        if kind == "h":
            return r.choice(_HANDLES) + r.choice(("", "_", ".", "")) + r.choice(("club", "log", "daily", "ev", d("99"), d("999"), ""))
        if kind == "z":
            return r.choice(_NICK_ZH) + r.choice(("", "", d("9"), d("99"), d("999")))
        if kind[:4] == "bare":
            return self.value("word" + kind[4:]).rstrip(".!?。！")
        if kind[:4] == "word":
            lang = kind[4:]
            dense, words = lang in ("zh", "ja"), _COMMON[lang].split()
            if lang == "zh" and r.random() < 0.6:
                words = words[:150] + _ORDINARY_ZH * 2
            some = []
            early = r.random() < 0.25
            for i in range(r.randint(3, 14)):
                x = r.choice(words)
                if r.random() < 0.12 or (early and i == 1):  # a measure
                    some.append(d(r.choice(("9", "99", "999", "-9", "9999"))) + ("" if dense else " ") + r.choice(_UNITS[lang].split()))
                elif r.random() < 0.04:
                    some.append(self.value(r.choice("BN")))
                some.append(x.capitalize() if i == 0 or r.random() < (0.35 if lang == "de" else 0.08) else x)
            if lang == "es" and r.random() < 0.2:
                some[0] = r.choice("¡¿") + some[0]
            return ("" if dense else " ").join(some) + r.choice(("。", "！", "") if dense else (".", "!", "?", ""))
        if kind == "j":
            return r.choice(_NICK_JA) + r.choice(("", d("9"), d("99")))
        return d("99999")


TYPES = {"P": "person_name", "E": "email", "T": "phone", "I": "id_number", "A": "street_address"}


def labelled_table(times: int = 3, seed: int = 7, patterns: tuple[str, ...] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) rows; a span is (start, end, type). patterns: some of PATTERNS, to hold the others out."""
    import re

    patterns = patterns or tuple(PATTERNS)
    fill = Filler(seed)
    slot = re.compile(r"\{(\w+)\}")
    rows = []

    def made(pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = "", [], 0
        for m in slot.finditer(pattern):
            out += pattern[at : m.start()]
            value = fill.value(m.group(1))
            if kind := TYPES.get(m.group(1)[0]):
                spans.append((len(out), len(out) + len(value), kind))
            out += value
            at = m.end()
        return out + pattern[at:], spans

    for _ in range(times):
        for p in patterns:
            a, s = made(p)
            if fill.r.random() < 0.4:  # sentences meet others
                b, t = made(fill.r.choice(patterns))
                joint = "" if a[-1] in "。！？" else " "
                s = s + [(x + len(a) + len(joint), y + len(a) + len(joint), k) for x, y, k in t]
                a = a + joint + b
            rows.append((a, s))
        for p in FIELDS * 4:
            rows.append(made(p))
    return rows
