"""Given names by script and gender (fixed values), each once; names that are common words or places as well (May, Rose, Will, Paris) are left out."""

_LATIN_F = """
Adriana Agata Agnes Agnieszka Aisha Alejandra Alessandra Alexandra Alice Alicia Alina Allison Amanda Amelia Amelie Amy Ana Anastasia Andrea Angela Angelika Anita Anja Anke Ann Anna Anne Annette Annika Antonia Ashley Astrid Aurora
Barbara Beata Beatrice Beatriz Berta Bettina Birgit Brenda Brigitte Camila Camille Carla Carmen Carol Caroline Catherine Cecilia Chantal Charlotte Chiara Christa Christina Christine Clara Claire Claudia Colette Concepción Cornelia Cristina Cynthia
Daniela Danielle Deborah Denise Diana Dolores Donna Dorothea Dorothy Edith Elena Eleanor Eleonora Elisa Elisabeth Elise Elizabeth Elke Ella Ellen Elsa Emily Emma Erika Esther Eva Evelyn Ewa Fatima Federica Fiona Franziska Francesca Françoise Frida
Gabriela Gabriele Gertrud Giovanna Gisela Giulia Gloria Greta Gudrun Hanna Hannah Heather Heidi Heike Helen Helena Helene Helga Hélène Ilse Inés Inga Ingeborg Ingrid Irene Irina Isabel Isabella Isabelle Jacqueline Jana Jane Janet Janice Jennifer Jenny Jessica Joan Joanna Johanna Josephine Juana Judith Julia Julie Juliette Jutta
Karen Karin Karla Katarina Katarzyna Kate Katharina Katherine Kathleen Kathrin Katja Kelly Kerstin Kimberly Klara Kristin Kristina Laura Lauren Lea Lena Linda Lisa Louise Lucia Lucie Lucy Luisa Luise Lydia Magdalena Małgorzata Manon Manuela Marcela Margaret Margarete Margarita Margot Maria María Mariana Marianne Marie Marina Marion Marta Martha Martina Mary Mathilde Megan Melanie Melissa Mercedes Mia Michelle Monica Monika Montserrat
Nadia Nadine Nancy Natalia Natalie Nathalie Nicole Nina Nora Olga Olivia Pamela Patricia Paula Pauline Petra Pilar Priya Rachel Raquel Rebecca Regina Renate Rita Roberta Rocío Rosa Rosemarie Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Simone Sinead Sofía Sonia Sophia Sophie Stephanie Susan Susanne Suzanne Svenja Sylvia Sylvie
Tamara Tania Tanja Tatjana Teresa Theresa Tina Ulrike Ursula Valentina Valeria Valérie Vanessa Vera Verónica Veronika Véronique Wendy Ximena Yolanda Yvonne Zoe Zofia
"""
_LATIN_M = """
Aaron Abdullah Adam Adrian Ahmed Alain Alan Albert Alberto Alejandro Alessandro Alex Alexander Alexandre Alfred Ali Álvaro Amit Anders Andreas Andrés Andrew André Anthony Antoine Anton Antonio Arjun Arnaud Arthur Axel
Benjamin Benoît Bernard Bernd Björn Bob Boris Brandon Brian Bruno Carl Carlo Carlos Charles Christian Christoph Christophe Christopher Claude Craig Damian Daniel Dariusz David Dennis Diego Dieter Dietmar Dirk Dmitri Dominik Donald Douglas
Edgar Edoardo Eduard Eduardo Edward Emil Emilio Emmanuel Enrique Eric Erich Erik Ernst Esteban Étienne Eugen Fabian Federico Felipe Felix Fernando Filip Florian Francesco Francisco François Frank Franz Fred Frederic Frederik Friedrich Fritz
Gabriel Gary Geoffrey Georg George Gerald Gerhard Gerard Gilles Giorgio Giovanni Giuseppe Gonzalo Gottfried Graham Gregor Gregory Guido Guillaume Guillermo Günter Günther Gustav Hans Harald Harold Hassan Heinrich Heinz Helmut Henri Henrik Henry Herbert Hermann Holger Horst Hugo
Ian Ibrahim Ignacio Igor Ivan Jacob Jacques Jaime Jakob James Jan Jason Javier Jean Jeffrey Jens Jeremy Jerome Jérôme Jerry Jesper Jim Joachim Joaquín Jochen Joe Johan Johann Johannes John Jonas Jonathan Jorge Jörg José Josef Joseph Joshua Juan Jukka Julian Julien Julio Jürgen Justin
Karl Keith Kenneth Kevin Klaus Konrad Konstantin Krzysztof Kurt Lars Laurent Lawrence Leo Leon Leonard Leonardo Liam Lorenzo Louis Luc Luca Lucas Ludwig Luigi Luis Lukas Łukasz Magnus Manfred Manuel Marc Marcel Marco Marcus Marek Mario Mark Markus Martin Mateo Matthew Matthias Matthieu Maurice Mauricio Maximilian Michael Michel Miguel Mikael Mikko Mohamed Mohammed Muhammad
Nathan Nicholas Nicolas Nikolai Nikolaus Nils Noah Norbert Olaf Oliver Olivier Omar Oscar Oskar Otto Pablo Paolo Pascal Patrick Paul Pavel Pedro Peter Philip Philipp Philippe Pierre Piotr Rafael Rainer Rajesh Ralf Ralph Ramón Raúl Raymond Reinhard Reiner René Ricardo Richard Robert Roberto Rodrigo Roger Roland Rolf Ronald Rudolf Rüdiger Ryan
Salvatore Samuel Scott Sean Sébastien Sebastian Sergej Sergio Siegfried Simon Stanislav Stefan Stefano Stephan Stephen Steve Steven Sven Theodor Thierry Thomas Thorsten Tim Timothy Tobias Todd Tomás Tomasz Torsten Udo Ulrich Uwe Valentin Vicente Viktor Vincent Vincenzo Vladimir Volker Walter Werner Wilhelm William Wolfgang Xavier Yannick Yusuf Yves Zachary
"""
_CYRILLIC_F = "Алина Алла Анастасия Анна Валентина Валерия Вера Виктория Галина Дарья Евгения Екатерина Елена Елизавета Зинаида Ирина Ксения Лариса Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Олеся Ольга Полина Раиса Светлана София Татьяна Ульяна Юлия Яна"
_CYRILLIC_M = "Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Григорий Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Леонид Максим Михаил Никита Николай Олег Павел Пётр Роман Семён Сергей Степан Фёдор Юрий Яков"
_GREEK_F = "Άννα Αγγελική Αικατερίνη Αλεξάνδρα Βασιλική Γεωργία Δέσποινα Δήμητρα Ειρήνη Ελένη Ευαγγελία Ευγενία Ιωάννα Κατερίνα Κωνσταντίνα Μαρία Παναγιώτα Παρασκευή Σοφία Σταυρούλα Χριστίνα"
_GREEK_M = "Αθανάσιος Αλέξανδρος Αντώνης Βασίλης Γεώργιος Γιάννης Γιώργος Δημήτρης Δημήτριος Ευάγγελος Ιωάννης Κώστας Κωνσταντίνος Μιχάλης Νίκος Νικόλαος Παναγιώτης Παύλος Πέτρος Σπύρος Σταύρος Χρήστος"
GIVEN = {
    ("latin", "f"): tuple(_LATIN_F.split()),
    ("latin", "m"): tuple(_LATIN_M.split()),
    ("cyrillic", "f"): tuple(_CYRILLIC_F.split()),
    ("cyrillic", "m"): tuple(_CYRILLIC_M.split()),
    ("greek", "f"): tuple(_GREEK_F.split()),
    ("greek", "m"): tuple(_GREEK_M.split()),
}
BY_NAME = {name: kind for kind, names in GIVEN.items() for name in names}
