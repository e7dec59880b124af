"""Word lists of the repairs. The dictionary is a parameter; this default has the frequent words of legal Indonesian."""

DICTIONARY = frozenset(
    "agama alokasi anggaran asli atas ayat badan bagian bahwa barang belanja bentuk besaran bupati dalam dana dan daerah dasar dengan desa dimaksud dinas dokumen dua fungsi hari hasil hingga hukum izin jabatan jasa jika jumlah kabupaten kantor kawasan kecamatan kegiatan kelurahan kepada kepala kerjasama kesehatan ketentuan ketua kewajiban khusus kota lain lampiran lembaga lingkungan masyarakat melalui memutuskan menetapkan mengingat menimbang menjadi menteri nama negara nilai nomor organisasi pajak pasal pejabat pelaksanaan pelayanan pembangunan pembayaran pemerintah pendapatan pengelolaan penerimaan pengawasan pengguna peraturan perangkat perubahan perusahaan pidana program provinsi rencana retribusi salinan sampah sebagaimana sebesar sekretaris setiap sosial sudah surat tahun tambahan tanah tanggal tata tempat tentang terhadap tersebut tugas uang umum undang unit untuk urusan usaha wajib walikota wilayah yang besar".split()
)
#: Fragments that never merge.
STOP = frozenset("di ke dari dan atau yang ini itu pada oleh untuk dengan dalam tidak akan telah sudah bagi para atas agar serta maka bila jika saat per antara hingga menjadi sampai sebagaimana tentang tersebut".split())
